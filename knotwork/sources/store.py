"""Parquet state of a graph, and the cache of extractions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork import schema
from knotwork.schema import Graph
from knotwork.sources.extract import VERSION
from knotwork.sources.files import Folder

POINTER = "tables/CURRENT"


FILES = "rel string, sha256 string, file_ord long, version string"


def save_graph(graph: Graph, out: Folder, files: DataFrame | None = None) -> Graph:
    """Write nodes and edges to a new folder, then switch a pointer file to it; readers see the old or the new state.

    The pointer names the new folder and the one before it, which readers may still hold; older ones are deleted. ``files`` (rel,
    sha256, file_ord) are those the graph was merged from, with their places; without them the stored ones stay.
    """
    spark = graph.nodes.sparkSession
    kept = files.select("rel", "sha256", "file_ord", F.lit(VERSION).cast("string").alias("version")) if files is not None else load_files(spark, out)
    name = uuid.uuid4().hex
    graph.nodes.write.parquet(out.at(f"tables/{name}/nodes"))
    graph.edges.write.parquet(out.at(f"tables/{name}/edges"))
    if kept is not None:
        kept.write.parquet(out.at(f"tables/{name}/files"))
    before = out.read(POINTER).split() if has_graph(out) else []
    out.write(POINTER, "\n".join([name, *before[:1]]))
    for old in before[1:]:
        out.delete(f"tables/{old}")
    return load_graph(spark, out)


def has_graph(out: Folder) -> bool:
    return out.exists(POINTER)


def load_graph(spark: SparkSession, out: Folder) -> Graph:
    name = out.read(POINTER).split()[0]
    return Graph(spark.read.parquet(out.at(f"tables/{name}/nodes")), spark.read.parquet(out.at(f"tables/{name}/edges")))


def load_files(spark: SparkSession, out: Folder) -> DataFrame | None:
    """The files that the stored graph was merged from; None where they were not kept."""
    path = f"tables/{out.read(POINTER).split()[0]}/files" if has_graph(out) else ""
    return spark.read.schema(FILES).parquet(out.at(path)) if path and out.exists(path) else None


def shrinks(prior_nodes: int, new_nodes: int) -> bool:
    """Whether a new graph is so much smaller that it should not replace the old one unasked."""
    return prior_nodes > new_nodes * 1.5


class Cache:
    """Extraction rows by (version, path, content hash); with ``by_content`` by (version, content hash) alone."""

    def __init__(self, spark: SparkSession, folder: Folder, by_content: bool = False):
        self.spark, self.folder, self.by_content = spark, folder, by_content
        self.keys = ["sha256"] if by_content else ["rel", "sha256"]

    @property
    def version(self) -> str:
        return f"version={VERSION}"

    def rows(self) -> DataFrame:
        if self.folder.exists(self.version):
            return self.spark.read.schema(schema.EXTRACTED).parquet(self.folder.at(self.version))
        return self.spark.createDataFrame([], schema.EXTRACTED)

    def split(self, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Cached rows of the files, with their present order, and the files that have to be extracted."""
        rows = self.rows()
        known = rows.select(*self.keys).distinct()
        first = rows.join(rows.where("id IS NOT NULL").groupBy(*self.keys).agg(F.min("rel").alias("rel_0")), self.keys).where("rel = rel_0").drop("rel_0") if "rel" not in self.keys else rows
        return self.at_places(first, contents), contents.join(known, self.keys, "left_anti")

    def at_places(self, rows: DataFrame, contents: DataFrame) -> DataFrame:
        """The rows of present files, with their present order."""
        o = F.struct("file_ord", "ord.phase", "ord.ordinal", "ord.sub")
        return rows.join(contents.select("file_ord", *self.keys), self.keys).withColumn("ord", o).select(*rows.columns)

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.folder.at(self.version))

    def clear(self) -> int:
        """Drop every entry; the number of files removed."""
        n = self.folder.count(".parquet")
        self.folder.delete()
        return n
