"""Bounded traversals: level-synchronous frontier joins.

Each level joins the frontier with the ends of the edge table, once for each direction, and removes what was seen; no
closure of the edges is built, the aggregation by node drops what is reached twice. The frontier is broadcast while its
counted size is small, else both sides are shuffled. A level is cut with one reliable checkpoint, so plans stay short.
Every node carries the way it was reached first, which orders nodes without numbering a level before the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.operators.components import components
from knotwork.runtime import cut
from knotwork.schema import Graph

#: Rows of a frontier that may be broadcast; it is counted before.
BROADCAST_ROWS = 200_000
#: Words of bits that may be broadcast instead of ids.
MOST_WORDS = 1_000_000


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) of each edge in both directions, once."""
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()


def neighbours(edges: DataFrame, ids: DataFrame, directed: str = "both") -> DataFrame:
    """(id, neighbour, direction) of one hop from ``ids`` (id)."""
    out = edges.join(ids, edges["source"] == ids["id"]).select("id", F.col("target").alias("neighbour"), F.lit("out").alias("direction"))
    back = edges.join(ids, edges["target"] == ids["id"]).select("id", F.col("source").alias("neighbour"), F.lit("in").alias("direction"))
    return out.unionByName(back) if directed == "both" else out if directed == "out" else back


def seeds_table(spark: SparkSession, ids: list[str]) -> DataFrame:
    """Given start nodes in order as (id, pos)."""
    return spark.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], "id string, pos long")


#: Directions of a step: from source to target, from target to source.
OUT, IN = ("source", "target"), ("target", "source")


class Levels:
    """A breadth-first expansion from ``seeds`` (id, key), level by level, over ``edges`` in the given ``directions``.

    ``front`` is the last level (id, key) and ``count`` its rows. ``grow`` gives the key of a node from the smallest key among
    its neighbours of the level before.
    """

    def __init__(self, edges: DataFrame, seeds: DataFrame, directions: tuple[tuple[str, str], ...], grow, order: DataFrame | None = None) -> None:
        self.edges, self.directions, self.grow, self.order = edges, directions, grow, order
        self.front = cut(seeds)
        self.all, self.count = [self.front], self.front.count()

    def seen(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [x.select("id") for x in self.all])

    def step(self) -> None:
        few, front = self.count <= BROADCAST_ROWS, self.front.select(F.col("id").alias("from"), "key")
        ways = []
        for a, b in self.directions:
            ends = self.edges.select(F.col(a).alias("from"), F.col(b).alias("id"))
            ways.append(ends.join(F.broadcast(front) if few else front, "from").select("id", "key"))
        reached = reduce(DataFrame.unionByName, ways).groupBy("id").agg(F.min("key").alias("key"))
        new = reached.join(self.seen(), "id", "left_anti")
        new = new if self.order is None else new.join(self.order, "id", "left")
        self.front = cut(new.select("id", self.grow(F.col("key")).alias("key")))
        self.count = self.front.count()
        self.all.append(self.front)


def expand(edges: DataFrame, seeds: DataFrame, depth: int, directions: tuple[tuple[str, str], ...] = (OUT, IN), order: DataFrame | None = None) -> DataFrame:
    """Breadth-first expansion from ``seeds`` (id, pos): id, depth, pos.

    Positions follow level, then the smallest position among parents, then id (or ``order``: id, ord, then id). Levels stop
    at ``depth``, included, or at an empty frontier. A key is the position of a seed and the nodes on the way from it.
    """
    edges = edges.select("source", "target").persist()
    link = F.struct(F.col("ord").alias("o"), F.col("id").alias("i")) if order is not None else F.col("id")
    # the type of a way, from columns of the right types
    kind = "string" if order is None else f"struct<o:{order.schema['ord'].dataType.simpleString()},i:string>"
    first = seeds.select("id", F.struct(F.col("pos").cast("long").alias("seed"), F.array().cast(f"array<{kind}>").alias("way")).alias("key"))
    levels = Levels(edges, first, directions, lambda key: F.struct(key["seed"].alias("seed"), F.concat(key["way"], F.array(link)).alias("way")), order)
    total = levels.count
    for _ in range(depth):
        if not levels.count:
            break
        levels.step()
        total += levels.count
    edges.unpersist()
    rows = [x.select("id", F.lit(d).alias("depth"), "key") for d, x in enumerate(levels.all)]
    return numbered(reduce(DataFrame.unionByName, rows), ["depth", "key", "id"], total).drop("key")


def numbered(rows: DataFrame, by: list[str], total: int) -> DataFrame:
    """``pos`` from 0 in the order of ``by``: in one task while the counted rows are few, else by ranges, each from where the ranges
    before it end."""
    if total <= BROADCAST_ROWS:
        return rows.withColumn("pos", F.row_number().over(Window.orderBy(*by)).cast("long") - 1)
    # the identifier of a row is its range and, in the lower 33 bits, its place in it
    x = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    sizes = x.groupBy(F.shiftright("at", 33).alias("range")).count()  # one row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return x.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("range")).withColumn("pos", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "range", "start")


def bfs(graph: Graph, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` hops of any seed, edges taken both ways."""
    return expand(graph.edges, seeds, depth)


def affected(graph: Graph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes that reach a seed within ``depth`` edges; siblings in order of first sighting."""
    return expand(graph.edges, seeds, depth, (IN,), graph.nodes.select("id", "ord"))


def ego(graph: Graph, node_id: str) -> DataFrame:
    """A node, its successors in edge order, then predecessors not listed yet in node order: id, pos."""
    e = graph.edges
    succ = e.where(F.col("source") == node_id).select(F.col("target").alias("id"), F.lit(1).alias("part"), "ord")
    pred = e.where(F.col("target") == node_id).select(F.col("source").alias("id")).join(graph.nodes.select("id", "ord"), "id").select("id", F.lit(2).alias("part"), "ord")
    me = graph.nodes.where(F.col("id") == node_id).select("id", F.lit(0).alias("part"), "ord")
    once = me.unionByName(succ).unionByName(pred).groupBy("id").agg(F.min(F.struct("part", "ord")).alias("k"))
    return once.select("id", F.row_number().over(Window.orderBy("k", "id")).cast("long").alias("pos")).withColumn("pos", F.col("pos") - 1)


def shortest_path(graph: Graph, source: str, target: str, most: int = 1 << 20) -> list[str]:
    """A shortest undirected path, from the target on the neighbour with the smallest id at every step; empty if there is none.

    Levels grow from both ends, the smaller frontier first, until they meet. From the target a node carries the smallest way to
    it, from the source the way back by smallest ids, so the path comes from one join of the levels that meet.
    """
    spark = graph.edges.sparkSession
    if graph.nodes.where(F.col("id").isin(source, target)).select("id").distinct().count() < len({source, target}):
        return []
    edges = graph.edges.select("source", "target").persist()
    me = lambda x: spark.createDataFrame([(x, [x])], "id string, key array<string>")
    back = Levels(edges, me(source), (OUT, IN), lambda key: F.concat(F.array("id"), key))
    ahead = Levels(edges, me(target), (OUT, IN), lambda key: F.concat(key, F.array("id")))
    path: list[str] = []
    for _ in range(most):
        meet = back.front.select("id", F.col("key").alias("home")).join(ahead.front.select("id", "key"), "id")
        best = meet.agg(F.min(F.struct("key", "home")).alias("best")).first().best
        if best is not None:
            path = list(reversed(best["home"])) + list(reversed(best["key"]))[1:]
            break
        side = back if back.count <= ahead.count else ahead
        if not side.count:
            break
        side.step()
    edges.unpersist()
    return path


def dfs(graph: Graph, seeds: list[str], depth: int) -> list[str]:
    """Depth-first preorder: successors in edge order, then predecessors in node order, depth tested on entry.

    Preorder with a depth bound is sequential by nature. The ball around the seeds is found by joins; its
    induced edges, in order, come to the driver, which must hold them: what they are bounded by is the depth alone, since a
    budget shows only part of the nodes but every edge among all of them.
    """
    spark = graph.edges.sparkSession
    ball = cut(bfs(graph, seeds_table(spark, seeds), depth).select("id"))
    inside = induced(graph.edges, ball).select("source", "target", "ord")
    place = graph.nodes.join(ball, "id").select(F.col("id").alias("source"), F.col("ord").alias("node_ord"))
    after: dict[str, list[str]] = {}
    before: dict[str, list[str]] = {}
    for r in inside.orderBy("ord", "source", "target").toLocalIterator():
        after.setdefault(r.source, []).append(r.target)
    for r in inside.join(place, "source", "left").orderBy("node_ord", "source", "target").toLocalIterator():
        before.setdefault(r.target, []).append(r.source)
    order: dict[str, int] = {}
    stack = [(s, 0) for s in reversed(seeds)]
    while stack:
        node, d = stack.pop()
        if node in order or d > depth:
            continue
        order[node] = d
        stack += [(n, d + 1) for n in reversed([*after.get(node, []), *before.get(node, [])])]
    return list(order)


def _hashed(column: str, words: int) -> tuple[Column, Column]:
    """The word of an id's hash, and its bit there."""
    h = F.xxhash64(column)
    return F.pmod(h, F.lit(words)), F.shiftright(h, 58).bitwiseAND(F.lit(63)).cast("int")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (id).

    Where the ids are too many to be broadcast, bits of their hashes are, at most ``MOST_WORDS`` words of 64; only edges whose ends may both
    be among the ids are shuffled and compared.
    """
    count = ids.count()
    if count > BROADCAST_ROWS:
        # eight bits an id, so one in nine of the others passes; all that pass are compared below
        n = min(MOST_WORDS, count // 8)
        word, bit = _hashed("id", n)
        words = F.broadcast(cut(ids.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))))
        for end in ("source", "target"):
            word, bit = _hashed(end, n)
            edges = edges.join(words, (word == words["word"]) & (F.getbit(words["bits"], bit) == 1), "left_semi")
    s, t = ids.select(F.col("id").alias("source")), ids.select(F.col("id").alias("target"))
    return edges.join(s, "source", "left_semi").join(t, "target", "left_semi").select(*edges.columns)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of the undirected component of each node."""
    found = components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
