"""Communities: arrays and tables give the same, hashes are Spark's, every community is connected."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.operators import community, dealt_community, small_community, traverse
from knotwork.runtime import tables
from knotwork.schema import Graph


def planted(spark, groups, size, within, between, seed):
    r = random.Random(seed)
    ids = [f"{g}-{i}" for g in range(groups) for i in range(size)]
    edges = {(r.choice(ids), r.choice(ids)) for _ in range(between)} | {(f"{g}-{r.randrange(size)}", f"{g}-{r.randrange(size)}") for g in range(groups) for _ in range(within)}
    nodes = spark.createDataFrame([(x,) for x in [*ids, "alone"]], "id string")
    return Graph(nodes, spark.createDataFrame(sorted(edges), "source string, target string"))


def test_hash_is_sparks(spark):
    x = [0, 1, -1, 5, 2**40, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in x], "c long").select("c", F.xxhash64(F.lit(42), F.lit(7), "c").alias("two"), F.xxhash64(F.lit(3), "c").alias("one"))
    got = {r.c: (r.two, r.one) for r in df.collect()}
    two, one = small_community.xxhash64((42, 7), np.array(x)), small_community.xxhash64((3,), np.array(x))
    assert [got[i] for i in x] == list(zip(two.tolist(), one.tolist(), strict=True))


@pytest.mark.parametrize("resolution", [1.0, 1.7])
def test_tables_equal_arrays(spark, monkeypatch, resolution):
    g = planted(spark, 3, 8, 30, 8, 5)
    monkeypatch.setattr(community, "MAX_SPLITS", 0)
    arrays = sorted(map(tuple, community.communities(g, resolution).collect()))
    monkeypatch.setattr(community, "FEW", -1)
    assert sorted(map(tuple, community.communities(g, resolution).collect())) == arrays


def test_parts_equal_arrays(spark, monkeypatch):
    """A dozen parts, loops, nodes without links, and more than one level."""
    g = planted(spark, 3, 8, 30, 8, 6)
    g = Graph(g.nodes, g.edges.unionByName(spark.createDataFrame([("0-1", "0-1"), ("2-3", "2-3")], "source string, target string")))
    for name, value in (("MAX_SPLITS", 0), ("PASSES", 1), ("ROUNDS", 6)):
        monkeypatch.setattr(community, name, value)
    arrays = sorted(map(tuple, community.communities(g).collect()))
    monkeypatch.setattr(community, "FEW", -1)
    monkeypatch.setattr(dealt_community, "PART_LINKS", 15)
    made = []
    real = dealt_community.n_parts
    monkeypatch.setattr(dealt_community, "n_parts", lambda n: made.append(real(n)) or made[-1])
    assert sorted(map(tuple, community.communities(g).collect())) == arrays
    assert max(made) > 8


def test_hubs_keep_the_rounds_by_links(spark, monkeypatch):
    g = planted(spark, 2, 5, 12, 3, 7)
    for name, value in (("MAX_SPLITS", 0), ("PASSES", 1), ("ROUNDS", 6)):
        monkeypatch.setattr(community, name, value)
    arrays = sorted(map(tuple, community.communities(g).collect()))
    monkeypatch.setattr(community, "FEW", -1)
    monkeypatch.setattr(community, "HUB", 0)
    monkeypatch.setattr(dealt_community, "Parts", None)
    assert sorted(map(tuple, community.communities(g).collect())) == arrays


def test_a_round_shuffles_arrays_not_links(spark):
    """Before, every round shuffled a row for each link and way; now at most a message of arrays for each two parts."""
    linked = spark.range(40).selectExpr("id AS a").join(spark.range(40).selectExpr("id AS b")).where("a < b").withColumn("w", F.lit(1.0))
    nodes = spark.range(40).withColumn("m", F.lit(780.0))
    with tables(spark) as keep:
        parts = dealt_community.Parts(keep, linked, 780, nodes)
        state = parts.begin(nodes.selectExpr("id", "id AS c"))
        new, seen = parts.step(state, 0, 1.0, 42, 1e-9)
        assert new.count() <= parts.n * (parts.n + 1)
        assert (seen.moves > 0, seen.value) == (True, round(-40 * 39**2 / (4 * 780**2), 12))
        assert parts.named(new).count() == 40
        plan = spark._jvm.PythonSQLUtils.explainString(parts._with_blocks(["ids"], state.where("kind = 0"), dealt_community._named, "id long, c long")._jdf.queryExecution(), "simple")
        assert "InMemoryTableScan" in plan and plan.split("InMemoryTableScan")[0].count("Exchange") == 0
        parts.close()


def test_planted_groups_are_found(spark):
    g = planted(spark, 6, 20, 150, 20, 1)
    found = community.communities(g)
    rows = found.collect()
    assert len(rows) == 121 and len({r.id for r in rows}) == 121
    groups = {}
    for r in rows:
        groups.setdefault(r.community, set()).add(r.id.split("-")[0])
    assert sorted(map(sorted, groups.values())) == [["0"], ["1"], ["2"], ["3"], ["4"], ["5"], ["alone"]]
    c = found.select("id", "community")
    side = lambda end: c.select(F.col("id").alias(end), F.col("community").alias(f"c{end}"))
    inside = g.edges.join(side("source"), "source").join(side("target"), "target").where("csource = ctarget")
    parts = traverse.connected_components(g.nodes, inside).join(c, "id").groupBy("community").agg(F.countDistinct("component").alias("n"))
    assert parts.where("n > 1").count() == 0


def test_loops_alone_and_empty(spark):
    loops = Graph(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "a")], "source string, target string"))
    assert sorted(map(tuple, community.communities(loops).collect())) == [(0, "a"), (1, "b")]
    none = Graph(loops.nodes.limit(0), loops.edges.limit(0))
    assert community.communities(none).columns == ["community", "id"] and community.communities(none).count() == 0
    assert sorted(map(tuple, community.communities(Graph(loops.nodes, loops.edges.limit(0))).collect())) == [(0, "a"), (1, "b")]


def test_modularity_deals_links_once_for_each_end(spark):
    """Before, links were shuffled to be made distinct, then for each end."""
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "d"), ("d", "d")], "source string, target string")
    c = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "id string, community int")
    got = community.modularity(e, c.hint("merge"))
    # 4 links, 3 of them inside; degrees 3 and 5
    assert got.first()[0] == round(3 / 4 - (9 + 25) / 64, 6)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    # two sides of two joins, sums by community, and the last sum
    assert plan.count("Exchange") == 6
