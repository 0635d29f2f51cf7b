"""Node-link files by lines: the same graph as the document read whole, in the same order."""

import json

import pytest
from pyspark.sql import functions as F

from knotwork.operators.merge import completed_edges, completed_nodes
from knotwork.plans import registry
from knotwork.schema import Graph
from knotwork.sources import nodelink


def rows(df):
    return sorted(map(str, df.withColumn("extras", F.to_json("extras")).collect()))


@pytest.fixture
def saved(spark, tmp_path):
    n = 300
    place = "struct<file_ord:bigint,phase:int,ordinal:bigint,sub:int>"
    nodes = spark.createDataFrame([(f"n{i}", "é\n{ },", {"x": '{"a": [1, "},"]}'} if i % 3 else None, (0, 0, n - i, 0)) for i in range(n)], f"id string, name string, extras map<string,string>, ord {place}")
    edges = spark.createDataFrame([(f"n{i}", f"m{i * 7 % n}", i, (0, 1, i, 0)) for i in range(n)], f"source string, target string, line int, ord {place}")
    nodelink.save(Graph(completed_nodes(nodes), completed_edges(edges)), tmp_path / "g.json")
    return tmp_path / "g.json"


def test_lines_equal_the_document(spark, saved):
    doc = json.loads(saved.read_text("utf-8"))
    assert [x["id"] for x in doc["nodes"]] == [f"n{i}" for i in reversed(range(300))] and len(doc["links"]) == 300 and set(doc) == {"directed", "multigraph", "graph", "nodes", "links"}
    whole = nodelink.from_document(spark.read.schema(nodelink.FILE).option("multiLine", True).json(str(saved)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = nodelink._by_lines(spark, str(saved))
        assert all(x.rdd.getNumPartitions() > 3 for x in found)
        got = nodelink.load(spark, saved)
        assert rows(got.nodes) == rows(whole.nodes) and rows(got.edges) == rows(whole.edges)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("change", [lambda d: json.dumps(d), lambda d: json.dumps(d, indent=2), lambda d: json.dumps(d, indent=2).replace('"nodes": [', '"nodes": [\n    {"id": "a"}, {"id": "b"},', 1)])
def test_other_layouts_are_read_whole(spark, saved, tmp_path, change):
    text = change(json.loads(saved.read_text("utf-8")))
    (tmp_path / "o.json").write_text(text, "utf-8")
    assert nodelink.load(spark, tmp_path / "o.json").nodes.count() == 600 + 2 * ('"id": "a"' in text)


def test_empty_graph(spark, tmp_path):
    nodelink.save(Graph(spark.createDataFrame([], nodelink.schema.NODES), spark.createDataFrame([], nodelink.schema.EDGES)), tmp_path / "e.json")
    assert json.loads((tmp_path / "e.json").read_text())["links"] == [] and nodelink.load(spark, tmp_path / "e.json").nodes.count() == 0


def test_parts_are_packed_and_no_rows_are_checkpointed(spark, tmp_path, monkeypatch):
    """Before, the parts lay beside the file as large as it, and the round trip's rows as unpacked checkpoints."""
    seen = []
    real = nodelink.Folder.join

    def join(self, name, pieces):
        seen.extend(p[1] for p in pieces if not isinstance(p, str))
        real(self, name, pieces)

    monkeypatch.setattr(nodelink.Folder, "join", join)
    monkeypatch.setattr(registry, "cut", None)
    got = registry.nodelink_roundtrip(spark, "/root/testdata/sf0.001")
    edges = registry.star_graph(spark, "/root/testdata/sf0.001").edges
    columns = ["source", "target", "type", "line", "confidence"]
    assert seen and all(x.endswith(".gz") for x in seen)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, edges.select(columns).collect()))
