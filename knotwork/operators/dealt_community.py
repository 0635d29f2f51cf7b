"""The rounds of ``community`` over parts: every part holds the links and the state of a share of the nodes in arrays, and parts tell each
other what changed in messages of arrays, which Spark shuffles.

A round is three exchanges. Parts send the sums of their nodes' weights by community to the part that a community belongs to, which answers with
the totals; parts send every other part the communities of those nodes that have links into it, and the totals of these communities; then
every part knows the communities in reach of its nodes, and they choose by the expressions of ``small_community``. Links are dealt once for all
rounds of a level; what a round shuffles are a few bytes for each node and part that it has links into, instead of a row for each link
and way. A part has at most a few million links; only the sums of a round's values reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators import small_community
from knotwork.runtime import ship_package

#: Links of a part, each in both directions: so many while the parts are few, then more, since every part may send to every other.
PART_LINKS, FEW_PARTS, MANY_LINKS = 1 << 18, 256, 1 << 21

BLOCK = "part int, ids binary, m binary, k binary, loop binary, ends binary, far binary, w binary, sizes binary, sends binary"
#: Kind 0: the communities x of a part's nodes, and figures of the round before. Kind 1: a message from ``origin`` to ``part``.
STEP = "part int, kind int, origin int, x binary, y binary, z binary, value double, moves long, wants long"
_STEP = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("origin", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary()), ("value", pa.float64()), ("moves", pa.int64()), ("wants", pa.int64())])
_BLOCK = pa.schema([("part", pa.int32()), *((x.split()[0], pa.binary()) for x in BLOCK.split(", ")[1:])])
_IDS = pa.schema([("id", pa.int64()), ("c", pa.int64())])


def n_parts(n_links: int) -> int:
    ways = 2 * n_links
    return max(1, min(-(-ways // PART_LINKS), max(FEW_PARTS, -(-ways // MANY_LINKS))))


def _array(cell: pa.Scalar, kind) -> np.ndarray:  # noqa: ANN001
    return np.frombuffer(cell.as_buffer(), kind)


def _steps(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True) if rows else [()] * len(_STEP), _STEP, strict=True)], schema=_STEP)


def _by_owner(label: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of communities by the part they belong to, then number, and how many belong to each part."""
    owner = label % parts
    return np.argsort(owner, kind="stable"), np.bincount(owner, minlength=parts)


def _pieces(sizes: np.ndarray) -> Iterable[tuple[int, slice]]:
    """The parts with anything, and where it lies."""
    stop = np.cumsum(sizes)
    return ((int(q), slice(stop[q] - sizes[q], stop[q])) for q in np.flatnonzero(sizes))


def _state(part: int, parts: int, c: np.ndarray, k: np.ndarray, value: float | None = None, moves: int = 0, wants: int = 0) -> pa.Table:
    """The row of a part's communities, and the sums of its weights for the parts that the communities belong to."""
    label, at = np.unique(c, return_inverse=True)
    total = np.bincount(at, k)
    order, sizes = _by_owner(label, parts)
    label, total = label[order], total[order]
    rows = [(part, 0, part, c.tobytes(), None, None, value, moves, wants)]
    return _steps(rows + [(q, 1, part, label[s].tobytes(), total[s].tobytes(), None, None, 0, 0) for q, s in _pieces(sizes)])


def _built(parts: int) -> Callable[..., pa.Table]:
    """A part from its links, each at both ends, and nodes (id, m)."""

    def built(links: pa.Table, nodes: pa.Table) -> pa.Table:
        if not links.num_rows:
            return _BLOCK.empty_table()
        part = links["part"][0].as_py()
        a, b, w = (links.column(x).to_numpy() for x in ("a", "b", "w"))
        ids, ends = np.unique(a, return_inverse=True)
        n, loops = len(ids), a == b
        loop = np.bincount(ends[loops], w[loops], n)
        k = np.bincount(ends, w, n) + loop
        node, m = nodes.column("id").to_numpy(), nodes.column("m").to_numpy()
        order = np.argsort(node)
        m = m[order][np.searchsorted(node, ids, sorter=order)]
        ends, b, w = ends[~loops], b[~loops], w[~loops]
        # nodes at far ends by part, then id; of the part itself all nodes
        near, at = np.unique(np.concatenate([b, ids]), return_inverse=True)
        order = np.argsort(near % parts, kind="stable")
        place = np.empty(len(near), np.int32)
        place[order] = np.arange(len(near), dtype=np.int32)
        # the other side of the same: nodes with links into a part, by part, then id
        to = np.unique(np.concatenate([b % parts * n + ends, part * n + np.arange(n)]))
        sizes = np.bincount(to // n, minlength=parts)
        cells = (ids, m, k, loop, ends.astype(np.int32), place[at[: len(b)]], w, sizes, (to % n).astype(np.int32))
        return pa.table([pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], schema=_BLOCK)

    return built


def _begun(parts: int) -> Callable[..., pa.Table]:
    """The first state of a part from nodes (id, c)."""

    def begun(block: pa.Table, nodes: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _steps([])
        ids, k = _array(block["ids"][0], np.int64), _array(block["k"][0], np.float64)
        node, c = nodes.column("id").to_numpy(), nodes.column("c").to_numpy()
        order = np.argsort(node)
        return _state(block["part"][0].as_py(), parts, c[order][np.searchsorted(node, ids, sorter=order)], k)

    return begun


def _totals(sums: pa.Table) -> pa.Table:
    """Answers of a part to the parts that sent sums of its communities, in the order in which they sent them."""
    label = [_array(x, np.int64) for x in sums["x"]]
    at = np.unique(np.concatenate(label), return_inverse=True)[1]
    total = np.bincount(at, np.concatenate([_array(x, np.float64) for x in sums["y"]]))[at]
    stop = np.cumsum([len(x) for x in label])
    part = sums["part"][0].as_py()
    return _steps([(o.as_py(), 1, part, None, total[e - len(x) : e].tobytes(), None, None, 0, 0) for o, x, e in zip(sums["origin"], label, stop, strict=True)])


def _told(parts: int) -> Callable[..., pa.Table]:
    """What a part tells the others: communities of nodes with links into them, by their places among the communities told, and totals."""

    def told(block: pa.Table, rows: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _steps([])
        part, rows = block["part"][0].as_py(), rows.sort_by([("kind", "ascending"), ("origin", "ascending")])
        label, at = np.unique(_array(rows["x"][0], np.int64), return_inverse=True)
        total = np.empty(len(label))
        total[_by_owner(label, parts)[0]] = np.concatenate([_array(x, np.float64) for x in rows["y"][1:]])
        sends, out = _array(block["sends"][0], np.int32), []
        for q, s in _pieces(_array(block["sizes"][0], np.int64)):
            few, places = np.unique(at[sends[s]], return_inverse=True)
            out.append((q, 1, part, label[few].tobytes(), total[few].tobytes(), places.astype(np.min_scalar_type(len(few))).tobytes(), None, 0, 0))
        return _steps(out)

    return told


def _chosen(parts: int, resolution: float, seed: int, turn: int, same: float) -> Callable[..., pa.Table]:
    """The next state of a part, from what it was told."""

    def chosen(block: pa.Table, rows: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _steps([])
        part, rows = block["part"][0].as_py(), rows.sort_by("origin")
        m, k, loop, w = (_array(block[x][0], np.float64) for x in ("m", "k", "loop", "w"))
        ends, far = (_array(block[x][0], np.int32) for x in ("ends", "far"))
        labels = [_array(x, np.int64) for x in rows["x"]]
        label, first, known = np.unique(np.concatenate(labels), return_index=True, return_inverse=True)
        total = np.concatenate([_array(x, np.float64) for x in rows["y"]])[first]
        near, begin = [], 0
        for x, z, origin in zip(labels, rows["z"], rows["origin"].to_pylist(), strict=True):
            near.append(known[begin + _array(z, np.min_scalar_type(len(x))).astype(np.int64)])
            begin += len(x)
            if origin == part:
                at = near[-1]
        go, to, into, wants = small_community.choices(ends, np.concatenate(near)[far], w, at, label, total, k, m, resolution, seed, turn, same)
        worth = small_community.worth(into, loop, total[at], k, m, resolution)
        c = label[at]
        c[go] = label[to]
        return _state(part, parts, c, k, float(worth.sum()), len(go), wants)

    return chosen


def _named(block: pa.Table, state: pa.Table) -> pa.Table:
    if not block.num_rows:
        return _IDS.empty_table()
    return pa.table({"id": _array(block["ids"][0], np.int64), "c": _array(state["x"][0], np.int64)}, schema=_IDS)


class Parts:
    """The links (a, b, w) of nodes (id, m) in parts, for any number of runs of rounds."""

    def __init__(self, keep: Callable[[DataFrame], DataFrame], linked: DataFrame, n_links: int, nodes: DataFrame) -> None:
        spark = linked.sparkSession
        ship_package(spark)
        self.keep, self.n = keep, n_parts(n_links)
        # a number for each part that Spark's hash deals to a partition of its own
        dealt = spark.range(40 * self.n).groupBy(F.pmod(F.hash("id"), F.lit(self.n)).alias("at")).agg(F.min("id").alias("seat"))
        self.seats = F.lit([r.seat for r in dealt.orderBy("at").collect()])
        ways = linked.unionByName(linked.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        ways = self._dealt(ways.withColumn("part", self._part("a"))).groupBy("seat")
        ways = ways.cogroup(self._dealt(nodes.select("id", "m", self._part("id").alias("part"))).groupBy("seat"))
        # a cached table stays dealt by part, so rounds shuffle nothing but messages
        self.blocks = self._dealt(keep(ways.applyInArrow(_built(self.n), BLOCK))).persist()

    def _part(self, column: str):  # noqa: ANN202
        return F.pmod(F.col(column), F.lit(self.n)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("seat", F.get(self.seats, F.col("part"))).repartition(self.n, "seat")

    def _with_blocks(self, columns: list[str], rows: DataFrame, task: Callable[..., pa.Table], schema: str) -> DataFrame:
        return self.blocks.select("seat", "part", *columns).groupBy("seat").cogroup(self._dealt(rows).groupBy("seat")).applyInArrow(task, schema)

    def begin(self, start: DataFrame) -> DataFrame:
        """The state of nodes (id, c)."""
        return self.keep(self._with_blocks(["ids", "k"], start.select("id", "c", self._part("id").alias("part")), _begun(self.n), STEP))

    def step(self, state: DataFrame, turn: int, resolution: float, seed: int, same: float):  # noqa: ANN201
        """(state after a round, figures of the state before it)."""
        totals = self._dealt(state.where("kind = 1")).groupBy("seat").applyInArrow(_totals, STEP)
        told = self._with_blocks(["sizes", "sends"], state.where("kind = 0").unionByName(totals), _told(self.n), STEP)
        new = self.keep(self._with_blocks(["m", "k", "loop", "ends", "far", "w"], told, _chosen(self.n, resolution, seed, turn, same), STEP))
        return new, new.where("kind = 0").agg(F.round(F.sum("value"), 12).alias("value"), F.sum("moves").alias("moves"), F.sum("wants").alias("wanting")).first()

    def named(self, state: DataFrame) -> DataFrame:
        """(id, c) of a state."""
        return self.keep(self._with_blocks(["ids"], state.where("kind = 0"), _named, "id long, c long"))

    def close(self) -> None:
        self.blocks.unpersist()
