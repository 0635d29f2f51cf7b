"""Scored search for the nodes that a question means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork import fixed_values as V
from knotwork.functions.text import favoured, may_score, short_name, term_score, terms_of
from knotwork.schema import Graph


def scored(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score) of every node that matches a term.

    A screen of compiled patterns keeps most nodes from the comparison; those that pass meet every term, and the points of
    a node are summed. Terms are rows, not a fold inside one expression, so a filter on points is an ordinary comparison of
    columns that is never moved below the union of a graph's parts.
    """
    if not terms:
        return nodes.select("id", F.lit(0).cast("long").alias("score")).limit(0)
    low = F.lower(F.coalesce("name", "id"))
    x = nodes.select("id", "type", low.alias("low"), short_name(low).alias("short"), F.lower("id").alias("low_id"))
    x = x.where(may_score(terms, F.col("low"), F.col("short"), F.col("low_id"))).withColumn("term", F.explode(F.array(*map(F.lit, terms))))
    x = x.withColumn("points", term_score(F.col("term"), F.col("low"), F.col("short"), F.col("low_id"))).where("points > 0")
    favour = F.max(favoured(F.col("type")))
    return x.groupBy("id").agg((F.sum("points") + favour).cast("long").alias("score"))


def seeds(nodes: DataFrame, terms: list[str], k: int = V.SEEDS) -> DataFrame:
    """The k best nodes, ties by id."""
    return scored(nodes, terms).orderBy(F.desc("score"), "id").limit(k)


def seed_ranks(nodes: DataFrame, terms: list[str], k: int = V.SEEDS) -> DataFrame:
    """The seeds with their rank from 1; the window sees at most k rows."""
    return seeds(nodes, terms, k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def seed_ids(nodes: DataFrame, terms: list[str], k: int = V.SEEDS) -> list[str]:
    return [r.id for r in seeds(nodes, terms, k).collect()] if terms else []


def resolve(graph: Graph, text: str, k: int = 1) -> str | None:
    """A node by its exact id, else the best seed of the text."""
    if graph.nodes.where(F.col("id") == text).head() is not None:
        return text
    return next(iter(seed_ids(graph.nodes, terms_of(text), k)), None)
