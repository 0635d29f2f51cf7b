"""``extract_code(rel, content)``: extraction as a table function, used in SQL by LATERAL.

    SELECT f.rel, x.* FROM files f, LATERAL extract_code(f.rel, f.content) x WHERE x.source IS NOT NULL

Each file gives its nodes (``id`` is set) and then its edges (``source`` and ``target`` are set), in order of ``place``. The language follows
from the suffix of ``rel``. A null path or content gives no rows; a source that does not parse gives its file alone, with ``error``.
Files travel to Python and rows back in Arrow batches; SQL prunes, filters and joins around the function as around any table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from knotwork.runtime import ship_package
from knotwork.sources.extract import extract_one

NAME = "extract_code"
FIELDS = ("id", "source", "target", "type", "name", "symbol", "src", "language", "level", "line", "confidence")
COLUMNS = (
    "place int, id string, source string, target string, type string, name string, symbol string, src string, language string, "
    "level int, line int, confidence string, error string"
)
_SUFFIX = re.compile(r".+(\.[^.]+)", re.DOTALL)


def suffix_of(rel: str) -> str:
    """As ``text.suffix``: a leading dot starts no suffix and a trailing one ends none."""
    m = _SUFFIX.fullmatch(rel.rsplit("/", 1)[-1])
    return m[1].lower() if m else ""


class ExtractCode:
    def eval(self, rel: str | None, content: str | None) -> Iterator[tuple]:
        if rel is None or content is None:
            return
        found = extract_one(rel, suffix_of(rel), content)
        for place, item in enumerate([*found.nodes, *found.edges]):
            yield (place, *(item.get(f) for f in FIELDS), None if place else found.error)


def register(spark: SparkSession) -> None:
    """Make ``extract_code`` known to the session."""
    ship_package(spark)
    spark.udtf.register(NAME, udtf(ExtractCode, returnType=COLUMNS, useArrow=True))


def extracted_by_sql(files: DataFrame, what: str = "f.rel, x.*", condition: str = "true") -> DataFrame:
    """Rows of a table with rel and content, by the table function."""
    spark = files.sparkSession
    register(spark)
    return spark.sql(f"SELECT {what} FROM {{files}} f, LATERAL {NAME}(f.rel, f.content) x WHERE {condition}", files=files)
