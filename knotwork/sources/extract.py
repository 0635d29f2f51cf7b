"""Extraction of nodes and edges from file contents, one Arrow-batched pass for all languages.

Python is parsed with ``ast``; the other languages are described by tables of rules over patterns. What a rule finds is
literal (EXTRACTED); calls and base classes are not resolved to definitions and point to ``symbol::?::<name>`` (INFERRED).
Line numbers of pattern languages are those where the match begins, which may be a blank line above.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from knotwork import fixed_values as V
from knotwork import schema
from knotwork.runtime import ship_package

EXTRACTED, INFERRED = "EXTRACTED", "INFERRED"
#: Part of the cache key: raise it whenever results change.
VERSION = 1


@dataclass
class Found:
    """What one file yields, in order."""

    rel: str
    language: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    seen: set[str] = field(default_factory=set)
    error: str | None = None

    def __post_init__(self) -> None:
        self.file = self.node("file", self.rel, self.rel, id=f"file::{self.rel}", language=self.language)

    def node(self, kind: str, key: str, name: str, once: bool = False, **more) -> str:
        nid = more.pop("id", f"{kind}::{self.rel}::{key}")
        if not (once and nid in self.seen):
            self.nodes.append({"id": nid, "type": kind, "name": name, "src": self.rel, "confidence": EXTRACTED, **more})
        self.seen.add(nid)
        return nid

    def edge(self, source: str, target: str, kind: str, confidence: str = EXTRACTED, **more) -> None:
        self.edges.append({"source": source, "target": target, "type": kind, "src": self.rel, "confidence": confidence, **more})

    def imports(self, module: str, line: int, symbols: tuple[str | None, ...] = (None,)) -> None:
        target = self.node("module", module, module, once=True, id=f"module::{module}")
        for s in symbols:
            self.edge(self.file, target, "imports", line=line, **({} if s is None else {"symbol": s}))

    def refers(self, source: str, symbol: str, kind: str, line: int | None = None) -> None:
        self.edge(source, f"symbol::?::{symbol}", kind, INFERRED, symbol=symbol, **({} if line is None else {"line": line}))


# --- Python ----------------------------------------------------------------------------------------------------


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a chain that starts at a name, the last attribute of any other chain, None for anything else."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.insert(0, node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *names])
    return names[-1] if names else None


def _define(out: Found, kind: str, node: ast.AST, scope: tuple[str, ...]) -> str:
    name = ".".join([*scope, node.name])
    nid = out.node(kind, name, name, line=node.lineno)
    out.edge(out.file, nid, "defines", line=node.lineno)
    return nid


def _calls(out: Found, owner: str, node: ast.AST) -> None:
    """Calls anywhere below a function, nested functions included, breadth first."""
    for x in ast.walk(node):
        if isinstance(x, ast.Call) and (name := dotted(x.func)) and name not in V.PYTHON_BUILTINS:
            out.refers(owner, name, "calls", x.lineno)


def _statement(out: Found, node: ast.AST, scope: tuple[str, ...]) -> None:
    match node:
        case ast.Import():
            for a in node.names:
                out.imports(a.name, node.lineno)
        case ast.ImportFrom():
            out.imports(node.module or ".", node.lineno, tuple(a.name for a in node.names))
        case ast.FunctionDef() | ast.AsyncFunctionDef():
            _calls(out, _define(out, "function", node, scope), node)
        case ast.ClassDef():
            owner = _define(out, "class", node, scope)
            for base in filter(None, map(dotted, node.bases)):
                out.refers(owner, base, "inherits", node.lineno)
            inner = (*scope, node.name)
            for x in node.body:
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    method = _define(out, "function", x, inner)
                    out.edge(owner, method, "has-method", line=x.lineno)
                    _calls(out, method, x)
                else:
                    _statement(out, x, inner)
        case _:
            for x in ast.iter_child_nodes(node):
                _statement(out, x, scope)


def python(rel: str, source: str) -> Found:
    """A source that does not parse yields its file alone, with the error's name."""
    out = Found(rel, "python")
    try:
        _statement(out, ast.parse(source), ())
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        out = Found(rel, "python", error=type(e).__name__)
    return out


# --- Pattern languages -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` become imports or definitions.

    ``kind`` is module, function or class; ``parents`` makes an inherits edge of the second group; ``once`` drops repeated
    definitions of a file; ``inside`` finds the names within the first group.
    """

    kind: str
    pattern: str
    flags: int = re.MULTILINE
    parents: bool = False
    once: bool = False
    inside: str | None = None
    reserved: frozenset[str] = frozenset()


JAVASCRIPT = (Rule("module", V.JS_IMPORT), Rule("function", V.JS_FUNCTION), Rule("function", V.JS_ARROW, once=True), Rule("class", V.JS_CLASS, parents=True))
RULES = {
    "javascript": JAVASCRIPT,
    "typescript": JAVASCRIPT,
    "go": (
        Rule("module", V.GO_IMPORT_BLOCK, re.DOTALL, inside=V.GO_QUOTED),
        Rule("module", V.GO_IMPORT_SINGLE, 0),
        Rule("function", V.GO_FUNCTION),
        Rule("class", V.GO_TYPE),
    ),
    "rust": (Rule("module", V.RUST_USE), Rule("function", V.RUST_FUNCTION), Rule("class", V.RUST_TYPE)),
    "java": (Rule("module", V.JAVA_IMPORT), Rule("class", V.JAVA_CLASS, parents=True), Rule("function", V.JAVA_METHOD, once=True, reserved=V.JAVA_RESERVED)),
}


class Lines:
    """Line numbers of offsets that mostly grow."""

    def __init__(self, source: str):
        self.source, self.at, self.line = source, 0, 1

    def __call__(self, offset: int) -> int:
        if offset < self.at:
            self.at, self.line = 0, 1
        self.line += self.source.count("\n", self.at, offset)
        self.at = offset
        return self.line


def by_rules(language: str) -> Callable[[str, str], Found]:
    def extract(rel: str, source: str) -> Found:
        out, line = Found(rel, language), Lines(source)
        for rule in RULES[language]:
            for m in re.finditer(rule.pattern, source, rule.flags):
                name = next(filter(None, m.groups()), None)
                if name is None or name in rule.reserved:
                    continue
                at = line(m.start())
                if rule.kind == "module":
                    for module in re.findall(rule.inside, name) if rule.inside else [name]:
                        out.imports(module, at)
                    continue
                known = f"{rule.kind}::{rel}::{name}" in out.seen
                if rule.once and known:
                    continue
                nid = out.node(rule.kind, name, name, line=at)
                out.edge(out.file, nid, "defines")
                if rule.parents and m[2]:
                    out.refers(nid, m[2], "inherits")
        return out

    return extract


def markdown(rel: str, source: str) -> Found:
    """Headings and links; every link belongs to the file's last heading."""
    out, line = Found(rel, "markdown"), Lines(source)
    owner = out.file
    for m in re.finditer(V.MARKDOWN_HEADING, source, re.MULTILINE):
        title, level = m[2].strip(), len(m[1])
        owner = out.node("heading", f"h{level}-{title}", title, level=level, line=line(m.start()))
        out.edge(out.file, owner, "contains")
    for m in re.finditer(V.MARKDOWN_LINK, source):
        if not m[2].startswith(("#", "mailto:")):
            target = out.node("link", m[2], m[2], once=True, id=f"link::{m[2]}")
            out.edge(owner, target, "links", line=line(m.start()))
    return out


LANGUAGE_BY_SUFFIX = {s: k for s, k in V.KIND_BY_SUFFIX.items() if k not in ("text", "config")}


def extract_one(rel: str, suffix: str | None, source: str) -> Found:
    """The extractor of the suffix; any other file is a text node."""
    language = LANGUAGE_BY_SUFFIX.get((suffix or "").lower(), "text")
    special = {"python": python, "markdown": markdown, "text": lambda r, _: Found(r, "text")}
    return (special.get(language) or by_rules(language))(rel, source)


_ARROW = pa.schema([
    *((c, pa.string()) for c in ("rel", "sha256", "id", "source", "target", "type", "name", "symbol", "src", "language")),
    ("level", pa.int32()), ("line", pa.int32()), ("confidence", pa.string()), ("error", pa.string()),
    ("ord", pa.struct([("file_ord", pa.int64()), ("phase", pa.int32()), ("ordinal", pa.int64()), ("sub", pa.int32())])),
])


class _Rows:
    """Rows of a batch as lists of its columns; dictionaries of rows would be most of the work beside parsing."""

    FOUND = tuple(c for c in _ARROW.names if c not in ("rel", "sha256", "error", "ord"))

    def __init__(self) -> None:
        self.found: list[tuple] = []
        self.more: list[tuple] = []
        self.ords: list[tuple] = []

    def __len__(self) -> int:
        return len(self.ords)

    def add(self, row: dict, rel: str, sha256: str | None, error: str | None, ord: tuple) -> None:  # noqa: A002
        self.found.append(tuple(map(row.get, self.FOUND)))
        self.more.append((rel, sha256, error))
        self.ords.append(ord)

    def batch(self) -> pa.RecordBatch:
        columns = dict(zip(self.FOUND, zip(*self.found, strict=True), strict=True)) | dict(zip(("rel", "sha256", "error"), zip(*self.more, strict=True), strict=True))
        kind = _ARROW.field("ord").type
        place = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*self.ords, strict=True), kind, strict=True)], fields=list(kind))
        return pa.RecordBatch.from_arrays([place if f.name == "ord" else pa.array(columns[f.name], f.type) for f in _ARROW], schema=_ARROW)


def extracted(contents: DataFrame) -> DataFrame:
    """Rows of nodes and edges of a table with file_ord, rel, suffix, content and (optionally) sha256."""
    ship_package(contents.sparkSession)
    has_sha = "sha256" in contents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _Rows()
            for f in b.to_pylist():
                if f["rel"] is None or f["content"] is None:
                    continue
                found = extract_one(f["rel"], f["suffix"], f["content"])
                for phase, part in enumerate((found.nodes, found.edges)):
                    for i, x in enumerate(part):
                        rows.add(x, f["rel"], f.get("sha256"), found.error if not phase and not i else None, (f["file_ord"], phase, i, 0))
                if len(rows) > 20_000:
                    yield rows.batch()
                    rows = _Rows()
            if len(rows):
                yield rows.batch()

    columns = ["file_ord", "rel", "suffix", "content", *["sha256"] * has_sha]
    return contents.select(*columns).mapInArrow(run, schema.EXTRACTED)


def nodes_of(rows: DataFrame) -> DataFrame:
    """The node rows of an extraction, not merged."""
    return rows.where("id IS NOT NULL").select("id", "type", "name", "src", "language", "level", "line", "confidence", "ord")


def edges_of(rows: DataFrame) -> DataFrame:
    """The edge rows of an extraction, not merged."""
    return rows.where("source IS NOT NULL").select("source", "target", "type", "symbol", "src", "line", "confidence", "ord")
