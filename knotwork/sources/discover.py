"""Listing of source trees.

The listing holds metadata only and decides order (entries by name, directories in place), so it runs on the driver; file
contents are read by the executors. Spark's own file sources hide names that begin with ``_`` or ``.``, which must
be seen here (``__init__.py``).
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from knotwork import fixed_values as V
from knotwork import schema
from knotwork.runtime import ship_package

#: The first of these that exists in the root holds the ignore patterns.
IGNORE_FILES = (".knotworkignore", ".gitignore")


def ignore_patterns(root: str | Path) -> list[str]:
    """Patterns of the root's ignore file, without blank lines and comments."""
    for name in IGNORE_FILES:
        p = Path(root) / name
        if p.exists():
            try:
                text = p.read_text(encoding="utf-8", errors="replace")
            except OSError:
                return []
            return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]
    return []


def path_matches(rel: str, pattern: str) -> bool:
    """One ignore pattern against a relative path; the driver's twin of ``functions.text.matches_pattern``."""
    body = pattern.rstrip("/")
    rooted, body = body.startswith("/"), body.removeprefix("/")
    if "/" in body:
        return fnmatch.fnmatchcase(rel, body) or rel.startswith(f"{body}/")
    parts = rel.split("/")
    return any(p == body or fnmatch.fnmatchcase(p, body) for p in (parts[:1] if rooted else parts))


def is_ignored(rel: str, patterns: list[str]) -> bool:
    """The last matching pattern decides."""
    return next((not p.startswith("!") for p in reversed(patterns) if path_matches(rel, p.removeprefix("!"))), False)


def kind_of(name: str) -> str:
    return V.KIND_BY_SUFFIX.get(PurePosixPath(name).suffix.lower(), "other")


def walk(root: str | Path, skip: frozenset[str] = frozenset()) -> Iterator[tuple[str, str]]:
    """(relative path, kind) of every file to extract, in walk order. ``skip``: real paths never entered, such as the
    output directory. Links to directories that are being walked already are not followed again."""
    base = Path(root).resolve()
    patterns = ignore_patterns(base)
    stack: list[tuple[Path, frozenset[str]]] = [(base, frozenset())]
    while stack:
        entry, above = stack.pop()
        rel = entry.relative_to(base).as_posix()
        if entry.is_dir():
            real = os.path.realpath(entry)
            hidden = entry.name.startswith(".") and entry.name != V.ALLOWED_DOT_DIRECTORY
            if entry != base and (entry.name in V.SKIPPED_DIRECTORIES or hidden or is_ignored(f"{rel}/", patterns)) or real in above or real in skip:
                continue
            try:
                inside = sorted(entry.iterdir(), key=lambda p: p.name, reverse=True)
            except OSError:
                continue
            stack += [(p, above | {real}) for p in inside]
        elif entry.is_file() and not is_ignored(rel, patterns) and (kind := kind_of(entry.name)) != "other":
            yield rel, kind


def discover(spark: SparkSession, root: str | Path, skip: frozenset[str] = frozenset()) -> DataFrame:
    """The ``files`` table of a source tree."""
    base = Path(root).resolve()
    rows = [(i, rel, str(base / rel), kind, PurePosixPath(rel).suffix.lower()) for i, (rel, kind) in enumerate(walk(base, skip))]
    return spark.createDataFrame(rows, schema.FILES)


def decoded(data: bytes) -> str:
    """UTF-8 with replacement characters, line ends as newlines."""
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def with_contents(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Read the files on the executors, from any store that pyarrow opens; files that cannot be read are left out."""
    ship_package(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                try:
                    store, path = fs.FileSystem.from_uri(row["path"]) if "://" in row["path"] else (fs.LocalFileSystem(), row["path"])
                    with store.open_input_stream(path) as f:
                        data = f.read()
                except OSError:
                    continue
                row |= {"sha256": hashlib.sha256(data).hexdigest(), "content": decoded(data)}
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("file_ord", "rel", "kind", "suffix", "sha256", "content")}], CONTENTS)

    dealt = files.repartition(partitions or files.sparkSession.sparkContext.defaultParallelism, "file_ord")
    return dealt.mapInArrow(read, schema.CONTENTS)


CONTENTS = pa.schema([("file_ord", pa.int64()), ("rel", pa.string()), ("kind", pa.string()), ("suffix", pa.string()), ("sha256", pa.string()), ("content", pa.string())])
