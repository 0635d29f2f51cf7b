"""Connected components of a link table, by alternating star operations (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.runtime import cut, release, tables

#: Nodes with at least this share of all rows get their smallest neighbour by a broadcast; there are at most 1 / SHARE of them.
SHARE, FEW = 0.001, 1000


def _stars(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One star operation on ``rows`` edges (u > v). Large: neighbours above u move to u's smallest; small: those below."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select(F.col("u").alias("w"), "m", "degree")
    hub = F.col("degree") >= max(FEW, int(SHARE * rows * (2 if large else 1)))
    # edges of a hub stay where they are, so no task gets all of them
    marked = both.join(F.broadcast(least.where(hub).select("w", F.col("m").alias("hub_m"))), both["u"] == F.col("w"), "left").select("u", "v", "hub_m")
    rest = marked.where("hub_m IS NULL").join(least.where(~hub), F.col("u") == F.col("w")).select("u", "v", "m")
    joined = rest.unionByName(marked.where("hub_m IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _is_open(edges: DataFrame) -> bool:
    """Whether any node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    per = ends.groupBy("id").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return not per.where("low > 1 OR (low > 0 AND high > 0)").isEmpty()


def stars(links: DataFrame) -> DataFrame:
    """(u, v): for each id with a smaller id in reach, the smallest one; ``links`` has (a, b), in any order.

    Each round is two aggregations and joins on node ids. Aggregations are partial before the shuffle, and hubs are joined by
    broadcasting at most 1 / SHARE of them, so no task gets all edges of a hub; rounds grow with the logarithm of the longest
    path. Only counts reach the driver.
    """
    spark = links.sparkSession
    with tables(spark) as keep:
        edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        while _is_open(edges):
            rows = edges.count()
            # neither operation makes more edges than it gets
            edges = keep(_stars(keep(_stars(edges, True, rows)), False, rows))
            release(spark)
        return cut(edges)


def members(edges: DataFrame) -> DataFrame:
    """(id, component) of stars (u, v)."""
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id with a link, the smallest id it reaches; ``links`` has (a, b), in any order."""
    return members(stars(links))
