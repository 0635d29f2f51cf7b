"""Counts, hubs, seams and suggested questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork import fixed_values as V
from knotwork.operators.traverse import BROADCAST_ROWS
from knotwork.runtime import cut


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node: edges in and out, a loop twice, 0 without edges."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, top: int = V.TOP_HUBS, noise: tuple[str, ...] = V.NOISE_MODULES) -> DataFrame:
    """The nodes of highest degree, ties by id, noise left out; attributes are joined to the few that stay."""
    best = degree(nodes, edges).where(~F.col("id").isin(*noise) if noise else F.lit(True)).orderBy(F.desc("degree"), "id").limit(top)
    x = best.join(nodes, "id")
    return x.select("id", "degree", F.coalesce("type", F.lit("?")).alias("type"), F.coalesce("name", "id").alias("name"), "src", "community")


def fallback_hubs(nodes: DataFrame, edges: DataFrame, top: int = V.FALLBACK_HUBS) -> DataFrame:
    """(id, degree) of the highest degrees, noise included."""
    return degree(nodes, edges).orderBy(F.desc("degree"), "id").limit(top)


#: Nodes of highest degree whose edges are looked at first for surprises.
FIRST_HUBS = 1000


def surprises(nodes: DataFrame, edges: DataFrame, communities: DataFrame, top: int = V.TOP_SURPRISES) -> DataFrame:
    """Edges between communities, the first of each unordered pair, by the sum of degrees, ties by first sighting.

    The best edges of the nodes of highest degree give a score that the result reaches at least, and of an edge with that score one end has
    half of it. So where few nodes have such a degree, only their edges are compared; else all are.
    """
    known = cut(communities.select("id", "community").join(degree(nodes, edges), "id", "left").select("id", "community", F.coalesce("degree", F.lit(0)).alias("degree")))
    first = cut(known.orderBy(F.desc("degree"), "id").limit(FIRST_HUBS))
    bound = _cross(edges, known, first).orderBy(F.desc("score")).limit(top).agg(F.min("score"), F.count("*")).first()
    high, least = None, None
    if bound[1] == top:
        least = bound[0]
        high = known.where(F.col("degree") * 2 >= least)
        high = high if high.count() <= BROADCAST_ROWS else None
    x = _cross(edges, known, high, least).orderBy(F.desc("score"), "ord").limit(top)
    return x.select("score", "source", "target", "source_community", "target_community", F.coalesce("type", F.lit("edge")).alias("type"), "src", "ord")


def _cross(edges: DataFrame, known: DataFrame, high: DataFrame | None = None, least: int | None = None) -> DataFrame:
    """The first edge of each unordered pair between communities, with its score, of pairs that score ``least``; ``known`` has (id,
    community, degree). Of edges with an end among the few rows ``high`` of it, if given, only the other end is shuffled."""
    side = lambda rows, end: rows.select(F.col("id").alias(end), F.col("community").alias(f"{end}_community"), F.col("degree").alias(f"{end}_degree"))
    if high is None:
        x = edges.join(side(known, "source"), "source").join(side(known, "target"), "target")
    else:
        x = edges.join(F.broadcast(side(high, "source")), "source", "left").join(F.broadcast(side(high, "target")), "target", "left")
        x = x.where("source_degree IS NOT NULL OR target_degree IS NOT NULL")
        lower = F.col("source_degree").isNull()
        x = x.withColumns({"lower": lower, "other": F.when(lower, F.col("source")).otherwise(F.col("target"))}).join(side(known, "other"), "other")
        x = x.withColumns({f"{end}_{c}": F.when(here, F.col(f"other_{c}")).otherwise(F.col(f"{end}_{c}")) for end, here in (("source", F.col("lower")), ("target", ~F.col("lower"))) for c in ("community", "degree")})
    x = x.where("source_community <> target_community").withColumn("score", F.col("source_degree") + F.col("target_degree"))
    x = x if least is None else x.where(F.col("score") >= least)
    columns = ["score", "source", "target", "source_community", "target_community", "type", "src", "ord"]
    return x.groupBy(F.least("source", "target").alias("p"), F.greatest("source", "target").alias("q")).agg(F.min_by(F.struct(*columns), "ord").alias("e")).select("e.*")


def type_counts(nodes: DataFrame) -> DataFrame:
    """(type, n) in descending n, ties by first sighting."""
    x = nodes.groupBy(F.coalesce("type", F.lit("?")).alias("type")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return x.orderBy(F.desc("n"), "first").drop("first")


def confidence_counts(edges: DataFrame) -> DataFrame:
    """(confidence, n) in descending n, ties by first sighting."""
    x = edges.groupBy(F.coalesce("confidence", F.lit("?")).alias("confidence")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return x.orderBy(F.desc("n"), "first").drop("first")


def community_sizes(nodes: DataFrame, communities: DataFrame, top: int = 20, sample: int = 5) -> DataFrame:
    """The largest communities with the names of their first members by id.

    Members are cut to ``sample`` a community by rank before they are gathered.
    """
    sizes = communities.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(top)
    ranked = communities.join(sizes, "community").withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("id"))).where(F.col("r") <= sample)
    named = ranked.join(nodes.select("id", "name"), "id", "left").groupBy("community", "n").agg(F.array_sort(F.collect_list(F.struct("r", F.coalesce("name", "id").alias("name")))).alias("s"))
    return named.select("community", "n", F.col("s.name").alias("sample"))


def community_members(communities: DataFrame) -> DataFrame:
    """(community, members): the map form, members in order. For export of communities that fit a row."""
    return communities.groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("members"))


def stats(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """One row: numbers of nodes, edges and communities."""
    n = nodes.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"))
    c = communities.agg(F.countDistinct("community").alias("communities")) if communities is not None else n.select(F.lit(0).cast("long").alias("communities"))
    key = F.lit(1).alias("k")
    return n.select("nodes", key).join(e.select("edges", key), "k").join(c.select("communities", key), "k").drop("k")


def questions(hub_rows: DataFrame, communities: int) -> DataFrame:
    """(pos, question): one for each of the three first hubs, then the general ones."""
    first = hub_rows.orderBy(F.desc("degree"), "id").limit(3)
    ranked = first.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("degree"), "id")).cast("long"))
    ask = F.concat(F.lit(V.QUESTION_OTHERWISE[0]), "name", F.lit(V.QUESTION_OTHERWISE[1]))
    for kind, (before, after) in V.QUESTION_BY_TYPE.items():
        ask = F.when(F.col("type") == kind, F.concat(F.lit(before), "name", F.lit(after))).otherwise(ask)
    general = [V.QUESTION_SUBSYSTEMS] * (communities > 1) + [V.QUESTION_ENTRY]
    spark = hub_rows.sparkSession
    rest = spark.createDataFrame([(100 + i, q) for i, q in enumerate(general)], "pos long, question string")
    both = ranked.select("pos", ask.alias("question")).unionByName(rest)
    return both.withColumn("pos", F.row_number().over(Window.orderBy("pos")).cast("long")).where(F.col("pos") <= V.MOST_QUESTIONS)
