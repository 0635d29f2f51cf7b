import json
from types import SimpleNamespace
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from knotwork.__main__ import main
from knotwork.functions.text import terms_of
from knotwork.operators import analytics, community, render, search, traverse
from knotwork.plans.engine import Engine, ShrinkError
from knotwork.sources import nodelink, store
from knotwork.sources.files import Folder
from knotwork.streaming.watch import settled, watch
from tests.conftest import PROJECT, write_tree


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    """A built engine that tests only read from."""
    base = tmp_path_factory.mktemp("engine")
    e = Engine(spark, base / "out")
    e.build(write_tree(base / "project", PROJECT), viz=True)
    return e


def test_build_counts_and_files(engine):
    g = engine.graph()
    assert (g.nodes.count(), g.edges.count()) == (21, 19)
    assert traverse.connected_components(g.nodes, g.edges).groupBy("component").count().select("count").orderBy("count").toPandas()["count"].tolist() == [1, 3, 5, 12]
    types = {r.type: r.n for r in analytics.type_counts(g.nodes).collect()}
    assert types == {"file": 4, "module": 3, "function": 5, "class": 1, "stub": 8}
    doc = json.loads((engine.out / "graph.json").read_text())
    assert len(doc["nodes"]) == 21 and len(doc["links"]) == 19 and doc["directed"] is True
    assert "God nodes" in (engine.out / "GRAPH_REPORT.md").read_text() and "d3" in (engine.out / "graph.html").read_text()
    assert json.loads((engine.out / "manifest.json").read_text())["stats"]["nodes"] == 21


def test_search_path_affected_hubs(engine):
    g = engine.graph()
    assert terms_of("how does authentication work") == ["authentication", "work"]
    got = {r.id: r.score for r in search.scored(g.nodes, ["authentication", "work"]).collect()}
    assert got == {"class::pkg/auth.py::Authenticator": 4, "function::pkg/auth.py::Authenticator.__init__": 4, "function::pkg/auth.py::Authenticator.login": 4, "module::pkg.auth": 4, "symbol::?::Authenticator": 3}
    best = search.seeds(g.nodes, ["authenticator", "login"]).collect()
    assert [(r.id, r.score) for r in best[:2]] == [("function::pkg/auth.py::Authenticator.login", 16), ("class::pkg/auth.py::Authenticator", 11)]
    assert engine.path("Authenticator", "lookup_user").startswith("No path between class::pkg/auth.py::Authenticator")
    assert {r.id for r in traverse.affected(g, traverse.seeds_table(engine.spark, ["class::pkg/auth.py::Authenticator"])).collect()} == {"class::pkg/auth.py::Authenticator", "file::pkg/auth.py"}
    hubs = analytics.hubs(g.nodes, g.edges, 5).orderBy(F.desc("degree"), "id").collect()
    assert [(r.name, r.degree) for r in hubs] == [("pkg/auth.py", 6), ("Authenticator.login", 4), ("hash_password", 4), ("Authenticator", 3), ("run", 3)]
    asked = [r.question for r in analytics.questions(analytics.hubs(g.nodes, g.edges), 2).orderBy("pos").collect()]
    assert asked[:3] == ["Walk me through `pkg/auth.py`.", "How does the `Authenticator.login` function work?", "How does the `hash_password` function work?"] and len(asked) == 5


def test_answers(engine):
    text = engine.query("auth login user", depth=4, budget=50)
    assert len(text.split("tokens\n", 1)[1]) <= 200
    assert "Did you mean" in engine.query("xyzzy_nonexistent_term") and engine.query("xyzzy_nonexistent_term").count("\n  - ") == 5
    assert engine.query("how is it").startswith("No usable terms")
    assert "STRATEGY: dfs" in engine.query("login", strategy="dfs") and "NODE id=" in engine.explain("Authenticator")
    assert engine.explain("???").startswith("Unknown node")
    assert engine.path("main.py", "run").startswith("PATH (2 nodes)")
    assert engine.affected("run").startswith("AFFECTED by function::main.py::run (depth 2)")


def fold_model(order, node_line, succ, pred, room):
    """Straightforward reading of the budget rules."""
    out, used, shown, edges = [], 0, set(), set()
    for n in order:
        if used + len(node_line[n]) + 1 > room:
            break
        out.append(node_line[n])
        used += len(node_line[n]) + 1
        shown.add(n)
        for group in ([(n, t) for t in succ.get(n, []) if t in order], [(s, n) for s in pred.get(n, []) if s in shown]):
            for e in group:
                if e in edges:
                    continue
                line = f"{e[0]}>{e[1]}" * 3
                if used + len(line) + 1 > room:
                    break
                out.append(line)
                used += len(line) + 1
                edges.add(e)
    return "\n".join(out)


def test_fitted_equals_model():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        ids = [f"n{i}" for i in range(rnd.randint(1, 9))]
        pairs = {(rnd.choice(ids), rnd.choice(ids)) for _ in range(rnd.randint(0, 20))}
        lines = {i: i * rnd.randint(1, 9) for i in ids}
        succ, pred = {}, {}
        for s, t in sorted(pairs):
            succ.setdefault(s, []).append(t)
            pred.setdefault(t, []).append(s)
        text = lambda s, t: f"{s}>{t}" * 3
        room = rnd.randint(0, 300)
        row = lambda line, owner=None, nth=None: SimpleNamespace(line=line, cost=len(line) + 1, owner=owner, owner_nth=nth)
        parts = {(i, 0): [row(lines[x])] for i, x in enumerate(ids)} | {(i, 1): [row(text(x, t)) for t in succ[x]] for i, x in enumerate(ids) if x in succ}
        for i, x in enumerate(ids):
            parts[i, 2] = [row(text(s, x), ids.index(s), succ[s].index(x) + 1) for s in pred.get(x, []) if ids.index(s) <= i]
        got = render.fitted(parts, room)
        assert got == fold_model(ids, lines, succ, pred, room)


def test_update_cache_and_guard(spark, python_tree, tmp_path):
    engine = Engine(spark, tmp_path / "out")
    engine.build(python_tree)
    assert engine.update(python_tree)["changed_files"] == 0
    (python_tree / "main.py").write_text("from pkg.auth import Authenticator\ndef run(): return login(Authenticator())\ndef extra(): return run()\n")
    s = engine.update(python_tree)
    assert (s["changed_files"], s["nodes"], s["edges"]) == (1, 23, 21)
    small = write_tree(tmp_path / "small", {"a.py": ""})
    with pytest.raises(ShrinkError):
        engine.build(small)
    assert engine.build(small, force=True)["nodes"] == 1
    assert engine.cache.clear() > 0 and engine.cache.rows().count() == 0


def test_equal_contents_keep_their_own_nodes(spark, tmp_path):
    root = write_tree(tmp_path / "r", {"a/__init__.py": "", "b/__init__.py": ""})
    e = Engine(spark, tmp_path / "o")
    e.build(root, cluster=False)
    assert e.build(root, cluster=False)["cache_hits"] == 2 and e.graph().nodes.count() == 2
    c = Engine(spark, tmp_path / "o2", cache_by_content=True)
    c.build(root, cluster=False)
    assert c.build(root, cluster=False, force=True)["nodes"] == 1


def test_mixed_tree_nodelink_and_callflow(spark, mixed_tree, tmp_path):
    e = Engine(spark, tmp_path / "o")
    assert {k: v for k, v in e.build(mixed_tree).items() if k in ("nodes", "edges")} == {"nodes": 10, "edges": 7}
    back = nodelink.load(spark, str(e.out / "graph.json"))
    g = e.graph()
    columns = ["id", "type", "name", "src", "language", "level", "line", "confidence", "community"]
    assert sorted(map(tuple, back.nodes.select(*columns).collect()), key=str) == sorted(map(tuple, g.nodes.select(*columns).collect()), key=str)
    assert sorted(map(tuple, back.edges.select("source", "target", "type", "line").collect()), key=str) == sorted(map(tuple, g.edges.select("source", "target", "type", "line").collect()), key=str)
    assert "graph TD" in e.export_callflow().read_text()


def test_nodelink_last_wins_and_stubs(spark, tmp_path):
    f = tmp_path / "g.json"
    f.write_text(json.dumps({"nodes": [{"id": "a", "name": "1", "odd": "x"}, {"id": "a", "name": "2"}], "links": [{"source": "a", "target": "b", "type": "t"}]}))
    g = nodelink.load(spark, str(f))
    rows = {r.id: r for r in g.nodes.collect()}
    assert rows["a"].name == "2" and rows["a"].extras == {"odd": '"x"'} and rows["b"].type == "stub" and rows["b"].confidence is None
    nodelink.save(g, tmp_path / "h.json")
    assert json.loads((tmp_path / "h.json").read_text())["nodes"][0] == {"id": "a", "name": "2", "odd": "x"}


def test_communities(spark, engine):
    g = engine.graph()
    c = community.communities(g)
    rows = c.collect()
    assert sorted(r.id for r in rows) == sorted(r.id for r in g.nodes.select("id").collect())
    assert {r.community for r in rows} == set(range(len({r.community for r in rows})))
    comp = {r.id: r.component for r in traverse.connected_components(g.nodes, g.edges).collect()}
    assert all(len({comp[r.id] for r in rows if r.community == k}) == 1 for k in {r.community for r in rows})
    whole = traverse.connected_components(g.nodes, g.edges).select(F.col("component").alias("community"), "id")
    assert community.modularity(g.edges, c).first()[0] >= community.modularity(g.edges, whole).first()[0] > 0
    again = community.communities(Engine(spark, engine.out).graph())
    assert sorted(again.collect()) == sorted(community.communities(g).collect())


def test_empty_graph(spark, tmp_path):
    e = Engine(spark, tmp_path / "o")
    (tmp_path / "r").mkdir()
    assert e.build(tmp_path / "r")["nodes"] == 0
    assert "No matching nodes" in e.query("anything")


def test_traversal_order_is_stable(spark, engine):
    g = engine.graph()
    seeds = traverse.seeds_table(spark, ["file::pkg/auth.py", "file::main.py"])
    one = traverse.bfs(g, seeds, 2).orderBy("pos").collect()
    mixed = type(g)(g.nodes.repartition(7), g.edges.repartition(5, "target"))
    assert one == traverse.bfs(mixed, seeds, 2).orderBy("pos").collect()
    assert [r.pos for r in one] == list(range(len(one)))
    ball = {r.id for r in one}
    walk = traverse.dfs(g, ["file::pkg/auth.py", "file::main.py"], 2)
    assert walk[0] == "file::pkg/auth.py" and set(walk) <= ball and walk == traverse.dfs(mixed, ["file::pkg/auth.py", "file::main.py"], 2)


def test_watch_once(spark, python_tree, tmp_path):
    e = Engine(spark, tmp_path / "o")
    for expected in (21, 22):
        q = watch(e, python_tree, once=True, checkpoint=str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert e.graph().nodes.count() == expected
        write_tree(python_tree, {"new.txt": "x"})


def test_command_line(spark, python_tree, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("KNOTWORK_OUT", str(tmp_path / "o"))
    assert main(["query", "x"], spark) == 1
    assert main(["build", str(python_tree), "--no-viz"], spark) == 0 and not (tmp_path / "o" / "graph.html").exists()
    assert main(["query", "login", "--dfs"], spark) == 0 and re.search("SEEDS: function", capsys.readouterr().out)
    assert main(["cluster-only", "--resolution", "2"], spark) == 0
    assert main(["explain", "login"], spark) == main(["path", "run", "login"], spark) == main(["affected", "run"], spark) == 0
    assert main(["export", "callflow-html"], spark) == 0 and main(["export", "other"], spark) == 2
    assert main([], spark) == 0 and store.has_graph(Folder(spark, tmp_path / "o"))


def test_values_of_other_files_keep_their_types(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "n": 5, "deep": {"x": [1, None, "2"]}, "yes": True, "text": "5", "none": None}, {"id": "b"}], "links": [{"source": "a", "target": "b", "weight": 1.5}]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    e = Engine(spark, tmp_path / "o")
    assert e.recluster(path=str(tmp_path / "x.json")) == 1  # written back to the file, not to the engine's folder
    back = json.loads((tmp_path / "x.json").read_text())
    a = {k: v for k, v in back["nodes"][0].items() if k != "community"}
    assert a == {k: v for k, v in doc["nodes"][0].items() if v is not None} and back["links"] == doc["links"]
    assert back["nodes"][0]["community"] == 0 and not store.has_graph(e.folder)


def test_state_in_a_store_that_only_spark_reads(spark, python_tree, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.kw.link./o", f"file://{tmp_path}")
    e = Engine(spark, "viewfs://kw/o/graph")
    assert e.build(python_tree)["nodes"] == 21 and e.graph().edges.count() == 19
    assert e.update(python_tree)["changed_files"] == 0
    assert str(e.export_callflow()).startswith("viewfs://") and (tmp_path / "graph" / "graph.json").exists()
    assert e.cache.clear() > 0 and not e.cache.folder.exists()


def test_a_burst_of_changes_is_waited_for(python_tree):
    def write():
        for i in range(4):
            time.sleep(0.3)
            write_tree(python_tree, {f"n{i}.txt": "x"})

    t = threading.Thread(target=write)
    t.start()
    assert settled(str(python_tree), still=1.0) >= 2 and not t.is_alive()
    assert settled(str(python_tree), still=0.3) == 0


def test_paths_and_large_levels(spark, engine, monkeypatch):
    """Meeting from both ends equals the tree from one end; numbering by ranges equals numbering in one task."""
    ring = [(f"n{i:02d}", f"n{(i + 1) % 12:02d}") for i in range(12)] + [("n00", "n06"), ("x", "y")]
    nodes = spark.createDataFrame([(x,) for x in sorted({v for e in ring for v in e})], "id string")
    edges = spark.createDataFrame(ring, "source string, target string")
    g = type(engine.graph())(nodes, edges)
    assert traverse.shortest_path(g, "n00", "n09") == ["n00", "n11", "n10", "n09"] and traverse.shortest_path(g, "n03", "n08") == ["n03", "n04", "n05", "n06", "n07", "n08"]
    assert traverse.shortest_path(g, "x", "n00") == [] and traverse.shortest_path(g, "x", "x") == ["x"] and traverse.shortest_path(g, "x", "none") == []
    one = traverse.bfs(g, traverse.seeds_table(spark, ["n03", "x"]), 9).orderBy("pos").collect()
    monkeypatch.setattr(traverse, "BROADCAST_ROWS", 3)
    assert one == traverse.bfs(g, traverse.seeds_table(spark, ["n03", "x"]), 9).orderBy("pos").collect() and len(one) == 14
