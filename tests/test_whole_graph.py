"""A registered query whose operator must see the whole star graph."""

from pathlib import Path

import pytest

from knotwork.operators import traverse
from knotwork.plans import registry
from knotwork.plans.star_graph import star_graph

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


def test_louvain_covers_every_node(spark):
    got = [r.id for r in registry.QUERIES["louvain"](spark, str(DATA)).collect()]
    assert sorted(got) == sorted(r.id for r in star_graph(spark, str(DATA)).nodes.select("id").collect())


def test_answer_runs_at_the_default_depth(spark, monkeypatch):
    depths = []
    real = traverse.bfs
    monkeypatch.setattr(traverse, "bfs", lambda g, first, depth, *rest, **more: depths.append(depth) or real(g, first, depth, *rest, **more))
    assert registry.QUERIES["answer"](spark, str(DATA)).count() > 1
    assert depths == [3]


def test_many_ids_leave_few_edges_to_shuffle(spark, monkeypatch):
    """Before, ids too many to be broadcast had every edge shuffled for each end."""
    edges = spark.range(30_000).selectExpr("concat('n', id % 3000) AS source", "concat('n', (id * 7 + 5) % 3000) AS target", "id AS ord")
    ids = spark.range(0, 3000, 5).selectExpr("concat('n', id) AS id")
    among = {r.id for r in ids.collect()}
    want = sorted(tuple(r) for r in edges.collect() if r.source in among and r.target in among)
    monkeypatch.setattr(traverse, "BROADCAST_ROWS", 100)
    got = traverse.induced(edges, ids.hint("merge"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2
