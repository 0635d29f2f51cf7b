"""Merging after a change of some files: only ids and pairs that changed files show are merged anew.

First-wins merging works on one key at a time, so a key that no changed file shows keeps its row. Retraction needs no inverse of the
aggregation: the keys of rows that left and of rows that came are found, and these keys alone are merged from all rows that show
them now. The other rows of the old graph go through as they are. While the counted keys are few they are broadcast, and the
large tables are only scanned; beyond that they are shuffled by the key.

Places (``ord``) of rows that stay must not change; ``sources.places`` gives files such places. Keys without any row left
vanish, an endpoint that lost its own row becomes a stub again. Empty changes keep the graph as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.merge import completed_edges, completed_nodes, first_stubs, merge_edges, merge_nodes
from knotwork.operators.traverse import BROADCAST_ROWS
from knotwork.runtime import cut
from knotwork.schema import Graph

PAIR = ["source", "target"]


@dataclass(frozen=True)
class Keys:
    """Distinct keys, evaluated, with their number."""

    rows: DataFrame
    count: int

    @classmethod
    def of(cls, rows: DataFrame) -> Keys:
        rows = cut(rows.distinct())
        return cls(rows, rows.count())

    def sent(self) -> DataFrame:
        return F.broadcast(self.rows) if self.count <= BROADCAST_ROWS else self.rows

    def within(self, df: DataFrame) -> DataFrame:
        return df.join(self.sent(), self.rows.columns, "left_semi").select(*df.columns)

    def without(self, df: DataFrame) -> DataFrame:
        return df.join(self.sent(), self.rows.columns, "left_anti").select(*df.columns)


def touched_pairs(left: Graph, came: Graph) -> Keys:
    """The pairs of ``Touched`` alone, for which nodes are not looked at."""
    return Keys.of(left.edges.select(*PAIR).unionByName(came.edges.select(*PAIR)))


@dataclass(frozen=True)
class Touched:
    """The ids and pairs that changed files show, before or after the change."""

    ids: Keys
    pairs: Keys

    @classmethod
    def by(cls, left: Graph, came: Graph) -> Touched:
        """From the unmerged rows of files that went (or their old version) and of files that came (or their new one)."""
        pairs = touched_pairs(left, came)
        ends = pairs.rows.select(F.explode(F.array(*PAIR)).alias("id"))
        return cls(Keys.of(left.nodes.select("id").unionByName(came.nodes.select("id")).unionByName(ends)), pairs)

    def near(self, edges: DataFrame) -> DataFrame:
        """Edge rows with an end among the ids: what their stubs and pairs are made of."""
        x = edges
        for end in PAIR:
            x = x.join(self.ids.sent().select(F.col("id").alias(end), F.lit(True).alias(f"{end}_in")), end, "left")
        return x.where("source_in OR target_in").select(*edges.columns)


@dataclass(frozen=True)
class Merged:
    """The graph after a change; ``anew`` holds the rows that were merged, all others come from the graph before."""

    graph: Graph
    anew: Graph


def merged(before: Graph, touched: Touched, now: Graph) -> Merged:
    """The graph of all rows ``now`` (unmerged, of every file that is present; other rows than those of touched ids may be left out)."""
    sightings = touched.ids.within(now.nodes).unionByName(touched.ids.within(first_stubs(now.edges)), allowMissingColumns=True)
    edges, anew = merged_edges(before.edges, touched.pairs, now.edges)
    anew = Graph(cut(merge_nodes(sightings)), anew)
    nodes = touched.ids.without(completed_nodes(before.nodes)).unionByName(anew.nodes)
    return Merged(Graph(nodes, edges), anew)


def merged_edges(before: DataFrame, pairs: Keys, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges after a change, and those that were merged anew."""
    anew = cut(merge_edges(pairs.within(now)))
    return pairs.without(completed_edges(before)).unionByName(anew), anew


def degree_changes(before: Graph, after: Merged, touched: Touched) -> DataFrame:
    """(id, change): edges that came less edges that went, at both ends; ids whose degree stays are left out."""
    gone = touched.pairs.within(before.edges.select(*PAIR)).withColumn("by", F.lit(-1))
    ends = after.anew.edges.select(*PAIR).withColumn("by", F.lit(1)).unionByName(gone).select(F.explode(F.array(*PAIR)).alias("id"), "by")
    return ends.groupBy("id").agg(F.sum("by").alias("change")).where("change <> 0")


def degrees(known: DataFrame, before: Graph, after: Merged, touched: Touched) -> DataFrame:
    """(id, degree) after a change from the degrees ``known`` before it: rows of ids that no changed file shows go through."""
    old = touched.ids.within(known.select("id", "degree"))
    renewed = after.anew.nodes.select("id").join(old, "id", "left").join(degree_changes(before, after, touched), "id", "left")
    kept = touched.ids.without(known.select("id", "degree"))
    return kept.unionByName(renewed.select("id", (F.coalesce("degree", F.lit(0)) + F.coalesce("change", F.lit(0))).cast("long").alias("degree")))
