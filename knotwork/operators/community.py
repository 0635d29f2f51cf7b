"""Communities: distributed Louvain with local moves between coloured communities, splits of oversize ones, modularity.

Every second round colours the communities anew, by a hash of their number. Nodes of one colour's communities may move, those
of the other's receive, and in the next round the other way round: no two nodes ever swap, none leaves a community that others join in that round, and
what a node gains is counted against communities that only grow. Of all communities in reach that receive, a node takes the one
of largest gain in modularity, if it gains more there than where it is. Links are dealt once for all rounds of a level to parts of
arrays, which exchange communities and totals as messages (``dealt_community``). Where a node has more than ``HUB`` links, a round is one
join of single links with the state of their far ends and two aggregations; sums go by (node, community) before they go by node, so no task
gets all links of a hub. Rounds end when no node would gain anywhere, or gains fade; then communities become nodes, and so on until
a level gains nothing. Then all nodes may move again, from the communities found, since the first moves were made by single nodes
that knew no communities. At last each community is refined to its connected parts, which never lowers modularity.

The same rounds run at every size, with the same results: a graph or level of at most ``FEW`` links, as the last ones are, is held in arrays
of the driver instead of tables, which only spares it the jobs. Of a graph of at most ``SHARED`` nodes the driver holds the communities alone, and a round is one
job over blocks of links (``shared_community``). Nodes are numbered in order of their ids, and ties are broken by
hashes, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from knotwork import fixed_values as V
from knotwork.operators import dealt_community, shared_community, small_community
from knotwork.operators.components import components
from knotwork.operators.traverse import numbered
from knotwork.runtime import cut, tables
from knotwork.schema import Graph

MAX_SPLITS, MIN_SPLIT_SIZE, SPLIT_FACTOR = 3, 4, 1.5
#: Rounds of a level at most; rounds that move nodes and gain less than ``GAIN`` in modularity end a level after ``PATIENCE`` of them; passes
#: over all levels at most, and the gain that makes another one worth while.
ROUNDS, PATIENCE, GAIN, PASSES, PASS_GAIN = 40, 3, 1e-3, 3, 3e-3
#: Differences below this are rounding.
SAME = 1e-9
#: Links of a level that come to the driver.
FEW = 500_000
#: Nodes whose communities, 13 bytes each, the driver may hold and send to all tasks, and links from which that is worth while.
SHARED, WORTH = 20_000_000, 500_000
#: Links of a node that may lie in one task, 24 bytes each; graphs with a larger hub take their rounds by joins of single links.
HUB = 4_000_000
Keep = Callable[[DataFrame], DataFrame]


Moves = Callable[[DataFrame], tuple[DataFrame, float]]


@contextmanager
def _moves(keep: Keep, linked: DataFrame, nodes: DataFrame, resolution: float, seed: int) -> Iterator[Moves]:
    """A function that gives (id, c) after local moves over links (a, b, w) of nodes (id, m) from a start (id, c), and its value; m is
    the weight of all links that count for a node."""
    n_links = linked.count()
    if n_links <= FEW:
        yield lambda start: _moved_here(linked, nodes.join(start, "id").select("id", "m", "c"), resolution, seed)
    elif _most_links(linked) > HUB:
        yield lambda start: _moved_in_tables(keep, linked, nodes.join(start, "id").select("id", "m", "c"), resolution, seed)
    else:
        parts = dealt_community.Parts(keep, linked, n_links, nodes)
        try:
            yield lambda start: _moved_in_parts(parts, start, resolution, seed)
        finally:
            parts.close()


def _most_links(linked: DataFrame) -> int:
    """The most links of a node."""
    return linked.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count().agg(F.max("count")).first()[0]


def _rounds(step: Callable[[DataFrame, int], tuple[DataFrame, Row]], state: DataFrame) -> tuple[DataFrame, float]:
    """The best state and its value; ``step`` gives the state after a round, and the value before it, moves and nodes that would gain."""
    best, most, before, faded = state, float("-inf"), None, 0
    for turn in range(ROUNDS):
        new, seen = step(state, turn)
        if seen.value is None:
            break
        if seen.value > most:
            best, most = state, seen.value
        if before is not None:
            faded = faded + 1 if seen.value - before < GAIN else 0
        if not seen.wanting or faded >= PATIENCE:
            break
        # a round without moves tells nothing
        before = seen.value if seen.moves else None
        state = new
    return best, most


def _moved_in_parts(parts: dealt_community.Parts, start: DataFrame, resolution: float, seed: int) -> tuple[DataFrame, float]:
    best, most = _rounds(lambda state, turn: parts.step(state, turn, resolution, seed, SAME), parts.begin(start))
    return parts.named(best), most


def _moved_in_tables(keep: Keep, linked: DataFrame, start: DataFrame, resolution: float, seed: int) -> tuple[DataFrame, float]:
    """The same rounds as joins and aggregations of single links, so that no task gets all links of a hub."""
    ends = linked.select(F.explode(F.array("a", "b")).alias("id"), "w", F.when(F.col("a") == F.col("b"), F.col("w") / 2).otherwise(0.0).alias("loop"))
    state = keep(ends.groupBy("id").agg(F.sum("w").alias("k"), F.sum("loop").alias("loop")).join(start, "id").select("id", "k", "m", "loop", "c"))
    apart = linked.where("a <> b").select("a", "b", "w")
    both = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    near = keep(both.join(state.select(F.col("id").alias("a"), "k", "m"), "a"))

    def step(state: DataFrame, turn: int) -> tuple[DataFrame, Row]:
        receives = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(turn // 2), c), F.lit(2)) == turn % 2
        by_chance = lambda c: F.xxhash64(F.lit(turn), c)
        known = state.join(state.groupBy("c").agg(F.sum("k").alias("all")), "c")
        to = near.join(known.select(F.col("id").alias("b"), "c", "all"), "b").select("a", "k", "m", "c", "w", "all", F.lit(False).alias("own"), F.lit(0.0).alias("loop"))
        mine = known.select(F.col("id").alias("a"), "k", "m", "c", F.lit(0.0).alias("w"), "all", F.lit(True).alias("own"), "loop")
        options = to.unionByName(mine).groupBy("a", "k", "m", "c").agg(F.sum("w").alias("into"), F.max("all").alias("all"), F.max("own").alias("own"), F.max("loop").alias("loop"))
        others = F.col("all") - F.when(F.col("own"), F.col("k")).otherwise(0.0)
        options = options.withColumn("gain", F.col("into") - resolution * others * F.col("k") / (2 * F.col("m")))
        other = F.struct("gain", by_chance(F.col("c")).alias("chance"), "c")
        per = options.groupBy("a", "k", "m").agg(
            F.max(F.when(F.col("own"), F.struct("c", "gain", "into", "all", "loop"))).alias("here"),
            F.max(F.when(~F.col("own"), F.col("gain"))).alias("any"),
            F.max(F.when(~F.col("own") & receives(F.col("c")), other)).alias("best"),
        )
        go = F.coalesce(~receives(F.col("here.c")) & (F.col("best.gain") > F.col("here.gain") + SAME), F.lit(False))
        wants = F.coalesce(F.col("any") > F.col("here.gain") + SAME, F.lit(False))
        # the value of the state before the moves comes with them
        worth = (F.col("here.into") / 2 + F.col("here.loop")) / F.col("m") - resolution * F.col("k") * F.col("here.all") / (4 * F.col("m") * F.col("m"))
        new = keep(per.select(F.col("a").alias("id"), "k", "m", F.col("here.loop").alias("loop"), F.when(go, F.col("best.c")).otherwise(F.col("here.c")).alias("c"), worth.alias("worth"), go.alias("go"), wants.alias("wants")))
        seen = new.agg(F.round(F.sum("worth"), 12).alias("value"), F.count_if("go").alias("moves"), F.count_if("wants").alias("wanting")).first()
        return new.select("id", "k", "m", "loop", "c"), seen

    best, most = _rounds(step, state)
    return best.select("id", "c"), most


Arrays = tuple[np.ndarray, ...]


def _arrays(linked: DataFrame, nodes: DataFrame) -> Arrays:
    """The nodes with links, in order, their m and c, and places and weights of links: at most ``FEW`` links come to the driver."""
    links = linked.toArrow()
    ends = linked.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    state = nodes.join(ends, "id", "left_semi").orderBy("id").toArrow()
    ids, m, c = (state.column(x).to_numpy() for x in ("id", "m", "c"))
    return ids, m, c, *(np.searchsorted(ids, links.column(x).to_numpy()) for x in "ab"), links.column("w").to_numpy()


def _moved_here(linked: DataFrame, start: DataFrame, resolution: float, seed: int) -> tuple[DataFrame, float]:
    """The same rounds over arrays of the driver."""
    ids, m, c, a, b, w = _arrays(linked, start)
    if not len(ids):
        return start.select("id", "c").limit(0), float("-inf")
    c, value = small_community.moved(ids, m, c, a, b, w, resolution, seed, ROUNDS, PATIENCE, GAIN, SAME)
    return linked.sparkSession.createDataFrame(pa.table({"id": ids, "c": c})), value


def _contracted(keep: Keep, linked: DataFrame, place: DataFrame) -> DataFrame:
    """The links between the communities ``place`` (id, c) of the nodes."""
    side = lambda end: place.select(F.col("id").alias(end), F.col("c").alias(f"c{end}"))
    x = linked.join(side("a"), "a").join(side("b"), "b")
    return keep(x.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))


def _by_number(nodes: DataFrame, n: int) -> np.ndarray:
    """The m of nodes (id, m) by their number below ``n``."""
    m, rows = np.zeros(n), nodes.select("id", "m").toArrow()
    m[rows.column("id").to_numpy()] = rows.column("m").to_numpy()
    return m


def _in_blocks(keep: Keep, linked: DataFrame, n_links: int, n: int, m: float | np.ndarray, resolution: float, seed: int) -> DataFrame:
    """``partition`` of nodes numbered from 0 to below ``n``, whose communities the driver holds."""

    def step(blocks: shared_community.Blocks) -> Callable:
        return lambda state, turn: blocks.step(state, turn, resolution, seed, SAME)

    def joined(small: DataFrame, most: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, float, Callable[[np.ndarray, int], DataFrame], Callable[[], None]]:
        """(communities of a level from single nodes, value, its links between communities, its end)."""
        small = keep(small)
        if (n_small := small.count()) > FEW:
            blocks = shared_community.Blocks(small, n_small, len(names), most, names)
            (c, _), found = _rounds(step(blocks), blocks.begin(np.arange(len(names))))
            return c, found, blocks.links_between, blocks.close
        links = small.toArrow()
        a, b, w = (links.column(x).to_numpy() for x in "abw")
        every = most if np.ndim(most) else np.full(len(names), most)
        c, found = small_community.moved(names, every, names, a, b, w, resolution, seed, ROUNDS, PATIENCE, GAIN, SAME)

        def between(c: np.ndarray, width: int) -> DataFrame:
            ca, cb = c[a], c[b]
            near, far, weight = small_community.summed(np.minimum(ca, cb), np.maximum(ca, cb), w, width)
            return linked.sparkSession.createDataFrame(pa.table({"a": near, "b": far, "w": weight}))

        return np.searchsorted(names, c), found, between, lambda: None

    blocks = shared_community.Blocks(linked, n_links, n, m)
    try:
        here = np.flatnonzero(blocks.k)
        place, value = np.arange(n), float("-inf")
        for _ in range(PASSES):
            (place, _), now = _rounds(step(blocks), blocks.begin(place))
            between, close = blocks.links_between, lambda: None
            label = np.unique(place[here])
            at = np.searchsorted(label, place).astype(np.int32)  # of nodes without links it does not matter
            at[at == len(label)] = 0
            names, inner = label, at
            while True:
                most = m
                if np.ndim(m):
                    most = np.zeros(len(names))
                    np.maximum.at(most, np.searchsorted(names, place[here]), m[here])
                small = between(inner, len(names))
                before = close
                c, found, between, close = joined(small, most, names)
                before()
                if found <= now + SAME:
                    break
                fades, now = found - now < GAIN, found
                # a community is named by one of its nodes
                place = names[c[np.minimum(np.searchsorted(names, place), len(names) - 1)]]
                if fades:
                    break
                chosen = np.unique(c)
                names, inner = names[chosen], np.searchsorted(chosen, c)
            close()
            if now - value < PASS_GAIN:
                break
            value = now
        return keep(blocks.named(blocks.connected(place.astype(np.int32))))
    finally:
        blocks.close()


def partition(keep: Keep, linked: DataFrame, nodes: DataFrame, resolution: float = 1.0, seed: int = V.LOUVAIN_SEED) -> DataFrame:
    """(id, c): communities of the nodes (id, m) of links (a, b, w), each named by one of its nodes and connected.

    Links join only nodes of equal m, the weight of all links that modularity is measured by. Nodes without links are left out.
    """
    n_links = linked.count()
    if n_links <= FEW:
        ids, m, _, a, b, w = _arrays(linked, nodes.withColumn("c", F.col("id")))
        place = small_community.partition(ids, m, a, b, w, resolution, seed, PASSES, PASS_GAIN, ROUNDS, PATIENCE, GAIN, SAME)
        return keep(linked.sparkSession.createDataFrame(pa.table({"id": ids, "c": place})))
    if n_links > WORTH and (n := nodes.agg(F.max("id")).first()[0] + 1) <= SHARED:
        every = nodes.select("m").distinct().limit(2).collect()
        m = every[0].m if len(every) == 1 else _by_number(nodes, n)
        return _in_blocks(keep, linked, n_links, n, m, resolution, seed)
    place, value = nodes.select("id", F.col("id").alias("c")), float("-inf")
    with _moves(keep, linked, nodes, resolution, seed) as moved:
        for _ in range(PASSES):
            place, now = moved(place)
            small = linked
            step = place
            while True:
                small = _contracted(keep, small, step)
                joints = nodes.join(place, "id").groupBy(F.col("c").alias("id")).agg(F.max("m").alias("m"))
                with _moves(keep, small, joints, resolution, seed) as joined:
                    step, found = joined(joints.select("id", F.col("id").alias("c")))
                if found <= now + SAME:
                    break
                fades, now = found - now < GAIN, found
                place = keep(place.select("id", F.col("c").alias("at")).join(step.select(F.col("id").alias("at"), "c"), "at").select("id", "c"))
                if fades:
                    break
            if now - value < PASS_GAIN:
                break
            value = now
    return _connected(keep, linked, place)


def _connected(keep: Keep, linked: DataFrame, place: DataFrame) -> DataFrame:
    """Communities cut into their connected parts, each named by its smallest node."""
    side = lambda end: place.select(F.col("id").alias(end), F.col("c").alias(f"c{end}"))
    inside = linked.where("a <> b").join(side("a"), "a").join(side("b"), "b").where("ca = cb").select("a", "b")
    parts = components(inside)
    return keep(place.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("c")))


def communities(graph: Graph, resolution: float = 1.0, seed: int = V.LOUVAIN_SEED, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(community, id): every node in one community, numbered from 0 by falling size, then smallest id.

    Communities above a quarter of the nodes are split up to three times at growing resolution, unless they have fewer
    than four nodes or a split leaves them whole. ``known``: what ``numbered_graph`` gives, where it is at hand.
    """
    with tables(graph.nodes.sparkSession) as keep:
        return cut(_numbered(keep, *(known or numbered_graph(keep, graph)), resolution, seed))


def numbered_graph(keep: Keep, graph: Graph) -> tuple[DataFrame, DataFrame]:
    """The nodes (id, n), numbered from 0 in order of their ids, and the links (a, b, w) of these numbers."""
    ids = keep(graph.nodes.select("id").distinct())
    number = keep(numbered(ids, ["id"], ids.count()).select(F.col("pos").alias("n"), "id"))
    return number, keep(numbered_links(graph.edges, number))


def numbered_links(edges: DataFrame, number: DataFrame) -> DataFrame:
    """Undirected links of weight 1, each once, between the numbers (id, n) of their ends, which are met by the hashes of their ids where
    all of these differ."""
    nodes, keys = number.agg(F.count("*"), F.count_distinct(F.xxhash64("id"))).first()
    key = F.xxhash64 if nodes == keys else F.col
    end = lambda c: number.select(key("id").alias(c), F.col("n").alias(f"n{c}"))
    x = edges.select(key("source").alias("s"), key("target").alias("t")).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
    # made distinct where the first join has dealt them, without another shuffle
    x = x.join(end("a"), "a").distinct().join(end("b"), "b")
    return x.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), F.lit(1.0).alias("w"))


def parts(keep: Keep, linked: DataFrame, n: int) -> DataFrame:
    """(id, component): the smallest number that each node with links (a, b, w) reaches; nodes are numbered from 0 to below ``n``."""
    linked = keep(linked)
    if not WORTH < (n_links := linked.count()) or n > SHARED:
        return components(linked.select("a", "b"))
    blocks = shared_community.Blocks(linked, n_links, n, 1.0)
    try:
        return keep(blocks.named(blocks.connected(np.zeros(n, np.int32))).withColumnRenamed("c", "component"))
    finally:
        blocks.close()


def _numbered(keep: Keep, number: DataFrame, base: DataFrame, resolution: float, seed: int) -> DataFrame:
    n_nodes = number.count()
    if not n_nodes:
        return number.select(F.lit(0).alias("community"), "id")
    total = float(base.agg(F.sum("w")).first()[0] or 0)
    alone = number.select(F.col("n").alias("id"))
    owner = alone.select("id", F.col("id").alias("c"))
    if total:
        owner = alone.join(partition(keep, base, alone.withColumn("m", F.lit(total)), resolution, seed), "id", "left").select("id", F.coalesce("c", "id").alias("c"))
    owner = keep(owner.withColumn("whole", F.lit(False)))
    most = max(1, int(n_nodes * V.LARGEST_COMMUNITY))
    for level in range(1, MAX_SPLITS + 1 if total else 1):
        # at most 1 / LARGEST_COMMUNITY of them
        large = owner.where("NOT whole").groupBy("c").agg(F.count("*").alias("n")).where((F.col("n") > most) & (F.col("n") >= MIN_SPLIT_SIZE)).select("c")
        inside = keep(owner.join(F.broadcast(large), "c").select("id", "c"))
        if inside.isEmpty():
            break
        side = lambda end: inside.select(F.col("id").alias(end), F.col("c").alias(f"c{end}"))  # noqa: E731, B023
        within = keep(base.join(side("a"), "a").join(side("b"), "b").where("ca = cb").select("a", "b", "w", F.col("ca").alias("c")))
        weight = within.groupBy("c").agg(F.sum("w").alias("m"))
        part = partition(keep, within.select("a", "b", "w"), keep(inside.join(F.broadcast(weight), "c").select("id", "m")), resolution * SPLIT_FACTOR**level, seed)
        part = inside.join(part.withColumnRenamed("c", "d"), "id", "left").select("id", "c", F.coalesce("d", "id").alias("d"))
        parts = part.groupBy("c").agg((F.countDistinct("d") == 1).alias("one"))
        new = part.join(F.broadcast(parts), "c").select("id", "d", "one")
        owner = keep(owner.join(new, "id", "left").select("id", F.coalesce("d", "c").alias("c"), F.coalesce("one", "whole").alias("whole")))
    per = owner.groupBy("c").agg((-F.count("*")).alias("size"), F.min("id").alias("first"))
    per = keep(per)
    order = numbered(per, ["size", "first"], per.count()).select("c", F.col("pos").cast("int").alias("community"))
    return owner.join(order, "c").join(number.select(F.col("n").alias("id"), F.col("id").alias("name")), "id").select("community", F.col("name").alias("id"))


def attached(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """Nodes with their community, the old one where the assignment has none."""
    new = assignment.select("id", F.col("community").alias("new"))
    return nodes.join(new, "id", "left").withColumn("community", F.coalesce("new", "community")).select(*nodes.columns)


def modularity(edges: DataFrame, assignment: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of the undirected graph under an assignment, rounded to 6 digits."""
    side = lambda end: assignment.select(F.col("id").alias(end), F.col("community").alias(f"c{end}"))
    # links are made distinct where the first join has dealt them, without another shuffle, and go on without the end that is known
    x = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).join(side("a"), "a").distinct().select("b", "ca").join(side("b"), "b")
    ends = x.select(F.explode(F.array("ca", "cb")).alias("c"), F.lit(1).alias("d"), F.when(F.col("ca") == F.col("cb"), 0.5).otherwise(0.0).alias("l"))
    per = ends.groupBy("c").agg(F.sum("d").alias("d"), F.sum("l").alias("l"))
    both = per.agg(F.sum("l").alias("l"), F.sum(F.col("d").cast("double") * F.col("d")).alias("dd"), (F.sum("d") / 2).alias("m"))
    return both.select(F.round(F.col("l") / F.col("m") - resolution * F.col("dd") / (4 * F.col("m") * F.col("m")), 6).alias("modularity"))


def threshold(nodes: DataFrame) -> DataFrame:
    """One row: the largest size a community keeps without a split."""
    return nodes.agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count("*") * V.LARGEST_COMMUNITY)).alias("threshold"))
