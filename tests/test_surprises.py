"""Surprises found from the hubs equal those of all edges."""

import pytest

from knotwork.operators import analytics
from knotwork.operators.merge import completed_edges, completed_nodes


def graph(spark, pairs):
    ids = sorted({x for p in pairs for x in p})
    nodes = completed_nodes(spark.createDataFrame([(x,) for x in ids], "id string"))
    rows = [(s, t, "calls", (0, 1, i, 0)) for i, (s, t) in enumerate(pairs)]
    edges = completed_edges(spark.createDataFrame(rows, "source string, target string, type string, ord struct<file_ord:bigint,phase:int,ordinal:bigint,sub:int>"))
    return nodes, edges, spark.createDataFrame([(int(x[1:]) % 3, x) for x in ids], "community int, id string")


@pytest.mark.parametrize(("hubs", "rows", "top"), [(1000, 1000, 5), (2, 1000, 5), (2, 0, 5), (1, 1000, 50), (2, 1000, 500)])
def test_equals_all_edges(spark, monkeypatch, hubs, rows, top):
    monkeypatch.setattr(analytics, "FIRST_HUBS", hubs)
    monkeypatch.setattr(analytics, "BROADCAST_ROWS", rows)
    pairs = list(dict.fromkeys((f"n{i * i % 41}", f"n{i * 7 % 13}") for i in range(60))) + [("n1", "n2"), ("n2", "n1")]
    pairs = list(dict.fromkeys(pairs))
    degree = {x: sum((s == x) + (t == x) for s, t in pairs) for x in {x for p in pairs for x in p}}
    first = {}
    for i, (s, t) in enumerate(pairs):
        if int(s[1:]) % 3 != int(t[1:]) % 3:
            first.setdefault(frozenset((s, t)), (i, s, t))
    want = sorted((-degree[s] - degree[t], i, s, t) for i, s, t in first.values())[:top]
    got = analytics.surprises(*graph(spark, pairs), top).collect()
    assert [(-r.score, r.ord.ordinal, r.source, r.target) for r in got] == want


def test_only_edges_of_high_nodes_are_compared(spark, monkeypatch):
    """Edges that cannot reach the score of the hubs' best ones are left before the pairs are grouped."""
    seen = []
    cross = analytics._cross
    monkeypatch.setattr(analytics, "_cross", lambda *given: seen.append(cross(*given).count()) or cross(*given))
    monkeypatch.setattr(analytics, "FIRST_HUBS", 1)
    pairs = [(f"n{3 * i + 1}", "n0") for i in range(1, 30)] + [(f"n{1000 + 3 * i}", f"n{2000 + i}") for i in range(200)]
    assert analytics.surprises(*graph(spark, pairs), 5).count() == 5 and seen == [29, 29]
