"""Communities held by the driver and sent to all tasks: the same as those of arrays, with no shuffle in a round."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.operators import community, dealt_community, shared_community, small_community
from knotwork.schema import Graph
from tests.test_community import planted


@pytest.mark.parametrize(("splits", "resolution"), [(1, 1.0)])
def test_blocks_equal_arrays(spark, monkeypatch, splits, resolution):
    """Several blocks, loops, nodes without links, more than one level, and levels with links too many for the driver."""
    g = planted(spark, 3, 8, 30, 8, 6)
    g = Graph(g.nodes, g.edges.unionByName(spark.createDataFrame([("0-1", "0-1"), ("2-3", "2-3")], "source string, target string")))
    monkeypatch.setattr(community, "MAX_SPLITS", splits)
    arrays = sorted(map(tuple, community.communities(g, resolution).collect()))
    monkeypatch.setattr(dealt_community, "Parts", None)
    monkeypatch.setattr(shared_community, "BLOCK_LINKS", 60)
    monkeypatch.setattr(community, "FEW", 10)
    monkeypatch.setattr(community, "WORTH", 10)
    assert sorted(map(tuple, community.communities(g, resolution).collect())) == arrays


def test_a_round_is_one_job_without_a_shuffle(spark):
    """Before, a round shuffled messages three times."""
    linked = spark.range(40).selectExpr("id AS a").join(spark.range(40).selectExpr("id AS b")).where("a < b").withColumn("w", F.lit(1.0))
    blocks = shared_community.Blocks(linked, 780, 40, 780.0)
    new, seen = blocks.step(blocks.begin(np.arange(40)), 0, 1.0, 42, 1e-9)
    assert (seen.moves > 0, seen.value) == (True, round(-40 * 39**2 / (4 * 780**2), 12))
    assert (np.bincount(new[0], blocks.k, 40) == new[1]).all()
    plan = spark._jvm.PythonSQLUtils.explainString(blocks.named(new[0])._jdf.queryExecution(), "simple")
    assert "InMemoryTableScan" in plan and plan.split("InMemoryTableScan")[0].count("Exchange") == 0
    blocks.close()


def test_sums_of_pairs():
    ends, far = np.array([1, 0, 1, 1]), np.array([2, 1, 2, 0])
    assert [x.tolist() for x in small_community.summed(ends, far, None, 3)] == [[0, 1, 1], [1, 0, 2], [1.0, 1.0, 2.0]]
    assert [x.tolist() for x in small_community.summed(ends, far, np.array([1.0, 2, 3, 4]), 3)] == [[0, 1, 1], [1, 0, 2], [2.0, 4.0, 4.0]]


def test_parts_of_blocks(spark, monkeypatch):
    """Before, the check of ``louvain_quality`` ran over ids in rounds of shuffles; the parts are the same by either way."""
    linked = spark.createDataFrame([(i, i + 2, 1.0) for i in range(0, 90, 3)] + [(i, i * 7 % 97, 1.0) for i in range(0, 90, 5)], "a long, b long, w double").selectExpr("least(a, b) AS a", "greatest(a, b) AS b", "w").distinct()
    with community.tables(spark) as keep:
        by_shuffles = dict(map(tuple, community.parts(keep, linked, 100).collect()))
        monkeypatch.setattr(community, "WORTH", -1)
        monkeypatch.setattr(shared_community, "BLOCK_LINKS", 20)
        monkeypatch.setattr(community, "components", None)
        by_blocks = dict(map(tuple, community.parts(keep, linked, 100).collect()))
    assert {i: c for i, c in by_blocks.items() if i != c} == {i: c for i, c in by_shuffles.items() if i != c} and max(by_shuffles.values()) > 0


def test_links_of_numbers(spark):
    number = spark.createDataFrame([(x, i) for i, x in enumerate("abcd")], "id string, n long")
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c"), ("d", "b"), ("x", "a")], "source string, target string")
    assert sorted(map(tuple, community.numbered_links(edges, number).collect())) == [(0, 1, 1.0), (1, 3, 1.0), (2, 2, 1.0)]
