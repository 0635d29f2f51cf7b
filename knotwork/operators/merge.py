"""Merging of extractions into a graph: keyed aggregations in which the first known value of each attribute wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork import schema
from knotwork.schema import Graph


def first_known(column: str, order: Column) -> Column:
    """The value of the row that is first in ``order`` among those where it is known; partially aggregable."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)


def _completed(df: DataFrame, layout: str) -> DataFrame:
    """``df`` with every column of a layout, absent ones as nulls."""
    fields = dict(x.strip().split(" ", 1) for x in layout.replace("map<string,string>", "map<string;string>").replace(",phase", ";phase").replace(",ordinal", ";ordinal").replace(",sub", ";sub").split(","))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t.replace(";", ",")).alias(c) for c, t in fields.items()])


def completed_nodes(df: DataFrame) -> DataFrame:
    return _completed(df, schema.NODES)


def completed_edges(df: DataFrame) -> DataFrame:
    return _completed(df, schema.EDGES)


def endpoint_stubs(edges: DataFrame) -> DataFrame:
    """A stub row for each endpoint of each edge, with the place of that sighting."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("sub")), F.struct(F.col("target").alias("id"), F.lit(1).alias("sub"))))
    o = F.struct(F.col("ord.file_ord"), F.col("ord.phase"), F.col("ord.ordinal"), F.col("e.sub").cast("int").alias("sub"))
    x = edges.select("ord", ends.alias("e"))
    return x.select(F.col("e.id").alias("id"), F.lit("stub").alias("type"), F.col("e.id").alias("name"), F.lit("INFERRED").alias("confidence"), o.alias("ord"))


def first_stubs(edges: DataFrame) -> DataFrame:
    """The first of the stub rows of each endpoint; they differ in their place alone."""
    first = endpoint_stubs(edges).groupBy("id").agg(F.min("ord").alias("ord"))
    return first.select("id", F.lit("stub").alias("type"), F.col("id").alias("name"), F.lit("INFERRED").alias("confidence"), "ord")


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id: real rows before stubs, then by place; ``ord`` is the first sighting of any kind.

    Maps cannot be ordered but may be carried, so ``extras`` follow the same rule. Each attribute goes through the shuffle with its
    place, so absent ones are added after it.
    """
    n = nodes if {"type", "ord"} <= set(nodes.columns) else completed_nodes(nodes)
    order = F.struct(F.coalesce(F.col("type") == "stub", F.lit(False)), F.col("ord"))
    return completed_nodes(n.groupBy("id").agg(*[first_known(c, order) for c in schema.NODE_ATTRIBUTES if c in n.columns], F.min("ord").alias("ord")))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row an ordered pair; later edges of a pair only fill what is missing."""
    e = edges if "ord" in edges.columns else completed_edges(edges)
    return completed_edges(e.groupBy("source", "target").agg(*[first_known(c, F.col("ord")) for c in schema.EDGE_ATTRIBUTES if c in e.columns], F.min("ord").alias("ord")))


def stub_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints without a node, as stubs."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").select("id", F.lit("stub").alias("type"), F.col("id").alias("name"), F.lit("INFERRED").alias("confidence"))


def build(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Merge rows of nodes and edges, adding stubs for endpoints, of which the first are found before."""
    all_nodes = nodes if "ord" in nodes.columns else completed_nodes(nodes)
    all_nodes = all_nodes.unionByName(first_stubs(completed_edges(edges)), allowMissingColumns=True)
    return Graph(merge_nodes(all_nodes), merge_edges(edges))
