"""A graph after a change of files equals the graph merged whole; only ids of changed files are merged."""

import random

from pyspark.sql import functions as F

from knotwork import schema
from knotwork.operators import analytics, incremental, merge
from knotwork.plans.engine import Engine
from knotwork.schema import Graph
from knotwork.sources import places, store

from tests.conftest import write_tree


def shown(graph):
    """Rows without places, and keys in the order of places."""
    n, e = graph.nodes.drop("ord", "extras", "community"), graph.edges.drop("ord", "extras")
    order = [[tuple(r) for r in df.orderBy("ord").select(*k).collect()] for df, k in ((graph.nodes, ["id"]), (graph.edges, ["source", "target"]))]
    return sorted(map(repr, n.collect())), sorted(map(repr, e.collect())), order


def test_update_equals_a_new_build(spark, python_tree, tmp_path):
    e = Engine(spark, tmp_path / "out")
    e.build(python_tree, cluster=False)
    old = (python_tree / "pkg/db.py").read_text()
    steps = [
        {"aaa.py": "from pkg.auth import Authenticator\ndef first(): return lookup_user(1, 2)\n", "pkg/c.md": "# Title\n\n[x](../main.py)\n"},
        {"pkg/db.py": "def other(): return 1\n", "aaa.py": None},
        {"pkg/db.py": old, "zz.txt": "nothing", "pkg/c.md": None, "main.py": None},
    ]
    for i, step in enumerate(steps):
        for rel, text in step.items():
            (python_tree / rel).unlink() if text is None else write_tree(python_tree, {rel: text})
        s = e.update(python_tree, cluster=False)
        whole = Engine(spark, tmp_path / f"whole{i}")
        whole.build(python_tree, cluster=False)
        assert shown(e.graph()) == shown(whole.graph())
        assert 0 < s["merged_ids"] < s["nodes"]
    assert e.update(python_tree, cluster=False)["merged_ids"] == 0
    before = shown(e.graph())
    e.cache.clear()
    (python_tree / "zz.txt").unlink()  # its old rows are no longer known, so all is merged
    s = e.update(python_tree, cluster=False)
    assert s["merged_ids"] == s["nodes"] and len(shown(e.graph())[0]) < len(before[0])
    assert {r.version for r in store.load_files(spark, e.folder).collect()} == {"1"}


def test_places():
    assert places.between([(0, 1)], {2: 30}) == {0: 10, 1: 20}
    assert places.between([(3, 3)], {2: 30}, 100) == {3: 130}
    assert places.between([(3, 4)], {2: 30, 5: 33}) == {3: 31, 4: 32}
    assert places.between([(3, 5)], {2: 30, 6: 33}) is None
    assert places.between([(0, 2)], {}, 8) == {0: 8, 1: 16, 2: 24} and places.between([], {}) == {}


def test_places_of_files(spark):
    files = lambda names: spark.createDataFrame([(i, x, x, "text", ".txt") for i, x in enumerate(names)], schema.FILES)
    known = places.fresh(files(["b", "d", "f"]))
    got, stable = places.placed(files(["a", "b", "c", "d", "e", "g"]), known)
    at = {r.rel: r.file_ord for r in got.collect()}
    assert stable and [at[x] for x in "bd"] == [places.GAP, 2 * places.GAP]
    assert sorted(at, key=at.get) == ["a", "b", "c", "d", "e", "g"] and len(set(at.values())) == 6
    assert not places.placed(files(["a", "b", "c", "d"]), known, most=1)[1]
    assert not places.placed(files(["b", "c", "d", "f"]), places.fresh(files(["b", "d", "f"]), 1))[1]


def test_random_changes(spark):
    """Rows of files that overlap in ids: attributes that are partly unknown, stubs that become nodes and the reverse, loops, empty sides."""
    rng = random.Random(5)

    def rows(f, version):
        r = random.Random(f"{f}/{version}")
        at = lambda phase, i: (f, phase, i, 0)
        nodes = [(f"n{r.randrange(12)}", r.choice([None, "class", "stub"]), r.choice([None, f"x{f}"]), r.choice([None, f]), at(0, i)) for i in range(r.randrange(4))]
        return nodes, [(f"n{r.randrange(12)}", f"n{r.randrange(12)}", r.choice([None, "calls"]), r.choice([None, f]), at(1, i)) for i in range(r.randrange(4))]

    def graph(files):
        got = [rows(*x) for x in files.items()]
        return Graph(
            spark.createDataFrame([n for g in got for n in g[0]], f"id string, type string, name string, line int, {schema.ORD}"),
            spark.createDataFrame([e for g in got for e in g[1]], f"source string, target string, type string, line int, {schema.ORD}"),
        )

    present = {f: 0 for f in range(6)}
    state = merge.build(graph(present).nodes, graph(present).edges)
    known = analytics.degree(state.nodes, state.edges)
    for step in range(4):
        after = {f: v + (rng.random() < 0.3) for f, v in present.items() if rng.random() < 0.8} | {10 * step + 10 + i: 0 for i in range(rng.randrange(3))}
        left = {f: v for f, v in present.items() if after.get(f) != v}
        came = {f: v for f, v in after.items() if present.get(f) != v}
        touched = incremental.Touched.by(graph(left), graph(came))
        new = incremental.merged(state, touched, graph(after))
        degrees = incremental.degrees(known, state, new, touched)
        whole = merge.build(graph(after).nodes, graph(after).edges)
        same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
        assert same(new.graph.nodes, whole.nodes) and same(new.graph.edges, whole.edges)
        assert same(degrees, analytics.degree(whole.nodes, whole.edges).withColumn("degree", F.col("degree").cast("long")))
        present, state, known = after, new.graph, degrees
