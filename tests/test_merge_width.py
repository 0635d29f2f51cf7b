"""What merging carries through its shuffles, and how often orders meet their lines."""

from pathlib import Path

import pytest

from knotwork import schema
from knotwork.operators import merge
from knotwork.plans import registry

SF = Path("/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_absent_attributes_are_not_merged(spark):
    nodes = spark.createDataFrame([("a", "class", (0, 0, 0, 0)), ("a", "stub", (0, 0, 1, 0))], f"id string, type string, {schema.ORD}")
    edges = spark.createDataFrame([("a", "b", "calls", (0, 1, 0, 0))], f"source string, target string, type string, {schema.ORD}")
    assert plan(merge.merge_nodes(nodes)).count("min_by(") == 1 and plan(merge.merge_edges(edges)).count("min_by(") == 1
    g = merge.build(nodes, edges)
    assert sorted((r.id, r.type, r.name, r.src) for r in g.nodes.collect()) == [("a", "class", "a", None), ("b", "stub", "b", None)]
    assert merge.merge_edges(edges).columns == merge.completed_edges(edges).columns


@pytest.mark.skipif(not SF.exists(), reason="the tables are not here")
def test_orders_meet_their_lines_once(spark):
    rows = registry._orders_changed(spark, str(SF))
    assert not any("l_orderkey" in plan(g.edges) for g in rows)
