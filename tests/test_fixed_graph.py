"""Results worked out by hand: two triangles joined by one edge, with a tail."""

import pytest

from knotwork import fixed_values as V
from knotwork.functions import code
from knotwork.operators import community, merge, render, traverse
from knotwork.schema import ORD, Graph

#: (id, type, name, line) and (source, target, type), in order.
NODES = [("a", "class", "Alpha", 1), ("b", "function", "alpha.load", 2), ("c", "function", "beta", 3), ("d", "class", "Delta", 4), ("e", "function", "gamma", 5), ("f", "function", "eps", 6), ("g", "file", "tail", 7)]
EDGES = [("a", "b", "calls"), ("b", "c", "calls"), ("a", "c", "imports"), ("c", "d", "calls"), ("d", "e", "calls"), ("e", "f", "calls"), ("d", "f", "imports"), ("f", "g", "links")]


@pytest.fixture(scope="module")
def graph(spark):
    place = lambda i, phase: {"file_ord": 0, "phase": phase, "ordinal": i, "sub": 0}
    nodes = spark.createDataFrame([(*n, "x.py", "EXTRACTED", place(i, 0)) for i, n in enumerate(NODES)], f"id string, type string, name string, line int, src string, confidence string, {ORD}")
    edges = spark.createDataFrame([(*e, "x.py", "EXTRACTED", place(i, 1)) for i, e in enumerate(EDGES)], f"source string, target string, type string, src string, confidence string, {ORD}")
    return Graph(merge.completed_nodes(nodes), merge.completed_edges(edges))


def node(i):
    x, t, n, line = NODES[i]
    return f"NODE id={x} type={t} name={n} src=x.py:{line} confidence=EXTRACTED"


def edge(i):
    s, t, kind = EDGES[i]
    return f"EDGE {s} --[{kind}]--> {t} src=x.py confidence=EXTRACTED"


def tokens(*lines):
    return -(-sum(len(x) + 1 for x in lines) // V.CHARACTERS_PER_TOKEN)


def test_depth_first(graph):
    """From c to depth 2: its successor d, whose successors e and f follow in order (g would be at depth 3); then c's predecessor
    a, from which b is met before it is c's next predecessor."""
    assert traverse.dfs(graph, ["c"], 2) == ["c", "d", "e", "f", "a", "b"]


def test_communities(graph):
    found = {}
    for r in community.communities(graph).collect():
        found.setdefault(r.community, set()).add(r.id)
    # whatever communities are, they are connected, numbered by size, and of at most a quarter of the nodes or not to be split
    assert sorted(x for c in found.values() for x in c) == list("abcdefg") and [len(found[i]) for i in range(len(found))] == sorted(map(len, found.values()), reverse=True)
    assert community.modularity(graph.edges, community.communities(graph)).first()[0] > 0.1


def lines(spark, graph, ids, budget=2000):
    return render.render(graph, traverse.seeds_table(spark, ids), budget).split("\n")


def test_lines_of_nodes_with_their_edges(spark, graph):
    assert lines(spark, graph, ["a", "b", "c"]) == [node(0), edge(0), edge(2), node(1), edge(1), node(2)]
    # an edge from a node that comes later is that node's own; unknown nodes have a line too
    assert lines(spark, graph, ["c", "a", "z"]) == [node(2), node(0), edge(2), "NODE id=z type=? name=z src=? confidence=?"]


def test_budgets(spark, graph):
    assert lines(spark, graph, ["a", "b", "c"], tokens(node(0), edge(0), edge(2))) == [node(0), edge(0), edge(2)]
    # the second edge of a does not fit, nor does any later line
    assert lines(spark, graph, ["a", "b", "c"], tokens(node(0), edge(0))) == [node(0), edge(0)]
    assert lines(spark, graph, ["a"], 3) == [""]


def test_an_edge_left_out_comes_with_its_other_end(spark):
    """a's long edge to c does not fit after a; b's line does, and so does the short edge that c takes up."""
    place = lambda i, phase: {"file_ord": 0, "phase": phase, "ordinal": i, "sub": 0}
    nodes = spark.createDataFrame([(x, "t", x, place(i, 0)) for i, x in enumerate("abc")], f"id string, type string, name string, {ORD}")
    edges = spark.createDataFrame([("a", "b", "x" * 300, place(0, 1)), ("a", "c", "y", place(1, 1))], f"source string, target string, type string, {ORD}")
    g = Graph(merge.completed_nodes(nodes), merge.completed_edges(edges))
    got = lines(spark, g, ["a", "b", "c"], 60)
    assert [x.split()[0] + x.split()[1] for x in got] == ["NODEid=a", "NODEid=b", "NODEid=c", "EDGEa"] and " --[y]--> c" in got[3]


def test_answer(graph):
    """beta and its neighbours: a node's edges out first, then edges in from nodes shown before."""
    want = ["QUESTION: where is beta", "TERMS: beta", "SEEDS: c", "DEPTH: 1 STRATEGY: bfs BUDGET: 2000 tokens", node(2), edge(3), node(0), edge(0), edge(2), node(1), edge(1), node(3)]
    assert render.answer(graph, "where is beta", depth=1).split("\n") == want


def test_table_function(spark):
    files = spark.createDataFrame([("a/m.py", "def f():\n    g(1)\n"), ("a/bad.py", "def ("), (".py", "x"), ("b.MD", "# T\n[l](u)\n"), ("n.py", None), (None, "x")], "rel string, content string")
    got = code.extracted_by_sql(files, "f.rel, x.place, x.id, x.source, x.target, x.line, x.error").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.rel, r.place)):
        by.setdefault(r.rel, []).append(r.id or f"{r.source}>{r.target}")
    assert by == {
        ".py": ["file::.py"], "a/bad.py": ["file::a/bad.py"], "a/m.py": ["file::a/m.py", "function::a/m.py::f", "file::a/m.py>function::a/m.py::f", "function::a/m.py::f>symbol::?::g"],
        "b.MD": ["file::b.MD", "heading::b.MD::h1-T", "link::u", "file::b.MD>heading::b.MD::h1-T", "heading::b.MD::h1-T>link::u"],
    }
    assert [r.error for r in got if r.rel == "a/bad.py"] == ["SyntaxError"]
    plan = code.extracted_by_sql(files)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan
