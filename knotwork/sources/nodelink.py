"""Node-link JSON: {directed, multigraph, graph, nodes: [{id, ...}], links: [{source, target, ...}]}.

``save`` makes the items in tasks, one on a line, and the file systems join the parts to one file. A file of that layout is read by lines, in as many
tasks as it has blocks; any other document is one value to Spark and read whole by one task.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork import schema
from knotwork.operators.merge import completed_edges, completed_nodes, stub_nodes
from knotwork.runtime import scratch_path
from knotwork.schema import Graph
from knotwork.sources.files import Folder

NODE_FIELDS = ("id", "type", "name", "src", "language", "level", "line", "confidence", "community")
EDGE_FIELDS = ("source", "target", "type", "symbol", "src", "line", "confidence")
_ITEM = "map<string,variant>"
#: What stands before, between and after the items that ``save`` writes, and what joins them.
START, MIDDLE, END, BETWEEN = '{\n  "directed": true,\n  "multigraph": false,\n  "graph": {},\n  "nodes": [', '\n  ],\n  "links": [', "\n  ]\n}\n", ",\n"
FILE = f"directed boolean, multigraph boolean, graph {_ITEM}, nodes array<{_ITEM}>, links array<{_ITEM}>"


def _table(document: DataFrame, column: str, fields: tuple[str, ...], layout: str) -> DataFrame:
    return _known(document.select(F.posexplode(F.coalesce(column, F.array().cast(f"array<{_ITEM}>"))).alias("at", "m")), column, fields)


def _known(x: DataFrame, column: str, fields: tuple[str, ...]) -> DataFrame:
    """One row an item (at, m), known fields as columns, others in ``extras`` as JSON texts, which keep their types, ``ord`` by place."""
    types = {"level": "int", "line": "int", "community": "int"}
    extras = F.transform_values(F.map_filter("m", lambda k, v: ~k.isin(*fields) & v.isNotNull() & ~F.is_variant_null(v)), lambda _, v: F.to_json(v))
    place = F.struct(F.lit(0).cast("long").alias("file_ord"), F.lit(0 if column == "nodes" else 1).alias("phase"), F.col("at").cast("long").alias("ordinal"), F.lit(0).alias("sub"))
    return x.select(*[F.try_variant_get(F.element_at("m", f), "$", types.get(f, "string")).alias(f) for f in fields], F.when(F.size(extras) > 0, extras).alias("extras"), place.alias("ord"))


def _last_known(df: DataFrame, keys: list[str], completed) -> DataFrame:
    """Items that repeat a key: the last known value of each attribute, the place of the first."""
    rest = [c for c in df.columns if c not in (*keys, "ord")]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    return completed(df.groupBy(*keys).agg(*map(last, rest), F.min("ord").alias("ord")))


def from_document(document: DataFrame) -> Graph:
    """The graph of a table of node-link documents (normally of one row), endpoints without a node as stubs."""
    return _graph(_table(document, "nodes", NODE_FIELDS, schema.NODES), _table(document, "links", EDGE_FIELDS, schema.EDGES))


def _graph(node_rows: DataFrame, edge_rows: DataFrame) -> Graph:
    nodes = _last_known(node_rows, ["id"], completed_nodes)
    edges = _last_known(edge_rows, ["source", "target"], completed_edges)
    place = F.struct(F.lit(1).cast("long").alias("file_ord"), F.lit(0).alias("phase"), F.lit(0).cast("long").alias("ordinal"), F.lit(0).alias("sub"))
    stubs = stub_nodes(nodes, edges).drop("confidence").withColumn("ord", place)
    return Graph(nodes.unionByName(completed_nodes(stubs)), edges)


def load(spark: SparkSession, path: str | os.PathLike) -> Graph:
    folder, file = os.path.split(os.fspath(path))
    folder = Folder(spark, folder or ".")
    if folder.head(file, len(START) + 1) == f"{START}\n".encode() and (found := _by_lines(spark, folder.at(file))):
        return _graph(*found)
    return from_document(spark.read.schema(FILE).option("multiLine", True).json(folder.at(file)))


def _by_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Rows of nodes and links of a file with one item a line, as ``save`` lays it out; None where a line is anything else."""
    x = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    item = F.col("value").startswith("    {")
    body = F.substring("value", 5, 1 << 30)
    body = F.when(F.endswith(body, F.lit(",")), F.left(body, F.length(body) - 1)).otherwise(body)
    x = x.select("block", "at", F.when(item, body).alias("item"), F.when(~item, F.col("value")).alias("frame"))
    wrong = F.col("item").isNotNull() & (~F.endswith("item", F.lit("}")) | F.try_parse_json("item").isNull())
    # one row for each block of the file
    blocks = x.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.count_if(wrong).alias("wrong"), F.max(F.when(F.col("frame") == MIDDLE.split("\n")[2], F.col("at"))).alias("middle"))
    blocks = blocks.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).collect()
    # the frame is a fixed number of lines; one more makes the file another kind of document
    expected = f"{START}{MIDDLE}{END}".rstrip("\n").split("\n")
    frame = [r.frame for r in x.where("frame IS NOT NULL").orderBy("block", "at").limit(len(expected) + 1).collect()]
    if frame != expected or any(b.wrong for b in blocks):
        return None
    middle = next(b.start + b.middle - b.first for b in blocks if b.middle is not None)
    starts = F.broadcast(spark.createDataFrame([(b.block, b.start - b.first) for b in blocks], "block long, shift long"))
    x = x.where("item IS NOT NULL").join(starts, "block").select((F.col("at") + F.col("shift")).alias("at"), F.from_json("item", _ITEM).alias("m"))
    side = lambda rows, first: rows.select((F.col("at") - first).alias("at"), "m")
    before = START.count("\n") + 1
    return _known(side(x.where(F.col("at") < middle), before), "nodes", NODE_FIELDS), _known(side(x.where(F.col("at") > middle), middle + 1), "links", EDGE_FIELDS)


def ordered_rows(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes in order, and links grouped by the order of their source node."""
    nodes = graph.nodes.orderBy("ord", "id")
    place = graph.nodes.select(F.col("id").alias("source"), F.col("ord").alias("node_ord"))
    edges = graph.edges.join(place, "source", "left").orderBy("node_ord", "source", "ord", "target")
    return nodes, edges


def save(graph: Graph, path: str | os.PathLike) -> None:
    """Write the document: tasks make the items, in order, and their parts are joined to one file, which replaces the old one."""
    spark = graph.nodes.sparkSession
    scratch = Folder(spark, scratch_path(spark, "node-link"))
    try:
        pieces: list = []
        for name, rows, fields, before in zip(("nodes", "links"), ordered_rows(graph), (NODE_FIELDS, EDGE_FIELDS), (START, MIDDLE), strict=True):
            # packed, since the parts and the file lie side by side
            _items(rows, fields).write.option("lineSep", BETWEEN).option("compression", "gzip").text(scratch.at(name))
            parts, size = [part for part, _ in scratch.parts(name)], 0
            while parts and not (size := scratch.unpacked_size(parts[-1])):
                parts.pop()
            if parts:
                parts = ["\n", *((scratch, part, -1) for part in parts[:-1]), (scratch, parts[-1], size - len(BETWEEN))]
            pieces += [before, *parts]
        folder, file = os.path.split(os.fspath(path))
        Folder(spark, folder or ".").join(file, [*pieces, END])
    finally:
        scratch.delete()


def _items(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(value): each row as an item, indented; nulls are left out, extras keep their types."""
    known = F.to_json(F.struct(*fields))
    quoted = lambda text: F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)
    more = F.transform(F.map_entries("extras"), lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.to_json(F.parse_json(e["value"]))))
    value = F.when(F.coalesce(F.size("extras"), F.lit(0)) > 0, F.concat(F.left(known, F.length(known) - 1), F.when(known == "{}", "").otherwise(","), F.array_join(more, ","), F.lit("}"))).otherwise(known)
    return rows.select(F.concat(F.lit("    "), value).alias("value"))
