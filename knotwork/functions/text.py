"""Native expressions over names, paths and questions."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from knotwork import fixed_values as V


def terms(question: Column) -> Column:
    """Search terms of a question: identifiers of two characters or more, lower case, without stop words, each once."""
    found = F.transform(F.regexp_extract_all(question, F.lit(f"({V.TERM})"), F.lit(1)), F.lower)
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*V.STOP_WORDS)))


def terms_of(question: str) -> list[str]:
    """The same on the driver, for a question given as a literal."""
    return list(dict.fromkeys(t for w in re.findall(V.TERM, question) if (t := w.lower()) not in V.STOP_WORDS))


def prefix_overlap(a: Column, b: Column) -> Column:
    """Length of the common prefix. The range starts at 0, so it is never empty nor counts down."""
    lengths = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(lengths, lambda i: F.left(a, i) == F.left(b, i)))


def short_name(name: Column) -> Column:
    """What follows the last dot, and in that the last ``::``."""
    return F.substring_index(F.substring_index(name, ".", -1), "::", -1)


def term_score(term: Column, name: Column, short: Column, node_id: Column) -> Column:
    """Score of one term against lower-case names: equal 10, in the name 5, in the id 2, shared prefix 3.

    A prefix is long enough with four characters and half of the shorter one of term and short name, so one comparison of
    that length tells.
    """
    k = F.greatest(F.lit(4), F.floor(F.least(F.length(term), F.length(short)) / 2).cast("int"))
    same = lambda s: (F.length(s) >= k) & (F.length(term) >= k) & (F.left(s, k) == F.left(term, k))
    return F.when((name == term) | (short == term), 10).when(F.contains(name, term), 5).when(F.contains(node_id, term), 2).when(same(short) | same(name), 3).otherwise(0)


def may_score(search: list[str], name: Column, short: Column, node_id: Column) -> Column:
    """Whether any term can score: three compiled patterns, which keep most nodes from the term by term comparison."""
    inside, begins = "|".join(search), "|".join({t[:4] for t in search if len(t) >= 4})
    begins = rf"\A(?:{begins})" if begins else r"\z\A."
    return name.rlike(f"{inside}|{begins}") | short.rlike(begins) | node_id.rlike(inside)


def favoured(node_type: Column) -> Column:
    """The point that a favoured type adds to a node that scores: 1 or 0."""
    return F.coalesce(node_type.isin(*V.FAVOURED_TYPES), F.lit(False)).cast("int")


def kind_of(path: Column) -> Column:
    """Kind by the suffix of the last component; a leading dot starts no suffix and a trailing one ends none."""
    table = F.create_map(*(F.lit(x) for pair in V.KIND_BY_SUFFIX.items() for x in pair))
    return F.coalesce(F.element_at(table, suffix(path)), F.lit("other"))


def suffix(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def _glob(pattern: str) -> str:
    """A shell pattern as a Java regular expression for a whole string; * crosses slashes."""
    body = fnmatch.translate(pattern)
    return body.removesuffix(r"\Z").removesuffix(r"\z") + r"\z"


def matches_pattern(path: Column, pattern: str) -> Column:
    """One ignore pattern: with a leading slash it is tied to the root, with an inner slash it is matched against the
    whole path or as a directory above it, otherwise against every component."""
    pat = pattern.rstrip("/")
    rooted = pat.startswith("/")
    pat = pat[1:] if rooted else pat
    if "/" in pat:
        return path.rlike(r"\A" + _glob(pat)) | F.startswith(path, F.lit(pat + "/"))
    if rooted:
        first = F.element_at(F.split(path, "/"), 1)
        return (first == pat) | first.rlike(r"\A" + _glob(pat))
    return F.exists(F.split(path, "/"), lambda part: part.rlike(r"\A" + _glob(pat)))


def ignored(path: Column, patterns: list[str]) -> Column:
    """The last pattern that matches decides; ``!`` takes a path back."""
    out = F.lit(False)
    for p in patterns:
        out = F.when(matches_pattern(path, p.removeprefix("!")), F.lit(not p.startswith("!"))).otherwise(out)
    return out


def pruned(path: Column, patterns: list[str]) -> Column:
    """Whether a file is ignored itself or lies below an ignored directory, which no later pattern can undo."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    return ignored(path, patterns) | F.when(F.size(parts) > 1, F.exists(above, lambda d: ignored(d, patterns))).otherwise(False)


def mermaid_id(node_id: Column) -> Column:
    """Letters, digits and underscores, not starting with a digit or underscore, at most 64 characters."""
    safe = F.regexp_replace(node_id, r"[^\p{L}\p{N}_]", "_")
    return F.left(F.when(safe.rlike(r"\A\p{L}"), safe).otherwise(F.concat(F.lit("n_"), safe)), F.lit(64))


def suffixed(line: Column) -> Column:
    """``:line`` where a line is known and not 0."""
    return F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(F.lit(":"), line.cast("string"))).otherwise("")


def node_line() -> Column:
    """The text line of a node row."""
    either = lambda c, d: F.coalesce(F.col(c), d)
    q = F.lit("?")
    return F.concat(F.lit("NODE id="), "id", F.lit(" type="), either("type", q), F.lit(" name="), either("name", F.col("id")), F.lit(" src="), either("src", q), suffixed(F.col("line")), F.lit(" confidence="), either("confidence", q))


def edge_line() -> Column:
    """The text line of an edge row."""
    either = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    return F.concat(F.lit("EDGE "), "source", F.lit(" --["), either("type", "edge"), F.lit("]--> "), "target", F.lit(" src="), either("src", "?"), suffixed(F.col("line")), F.lit(" confidence="), either("confidence", "?"))
