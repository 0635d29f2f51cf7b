"""The rounds of ``community`` over blocks of links, with the communities of all nodes in arrays that the driver sends to all tasks.

A block holds the links of a share of the nodes in arrays, by node, and is dealt once for all rounds of a level. A round is one job without a
shuffle: tasks get the community of every node, the total of every community and whether it receives, and answer with the nodes that
move. A node takes 13 bytes on the way to the tasks, and links never come to the driver, so this is for graphs of up to ``community.SHARED`` nodes. Levels are
contracted in tasks too, and connected parts are found by the same exchange, the smallest node in reach instead of a community.

Choices are made by the expressions of ``small_community``, so results are the same. Weights are whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import small_community
from knotwork.runtime import ship_package, trimmed

#: Links of a block, each at both of its ends.
BLOCK_LINKS = 1 << 20

_BLOCK = pa.schema([(x, pa.binary()) for x in ("ids", "degree", "far", "w", "k", "loop")])
BLOCK = ", ".join(f"{x} binary" for x in _BLOCK.names)
_MOVED = pa.schema([("node", pa.binary()), ("to", pa.binary()), ("value", pa.float64()), ("moves", pa.int64()), ("wants", pa.int64())])
MOVED = "node binary, to binary, value double, moves long, wants long"
_LOW = pa.schema([("node", pa.binary()), ("low", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())])
_IDS = pa.schema([("id", pa.int64()), ("c", pa.int64())])
Batches = Iterator[pa.RecordBatch]


def _array(cell: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _built(batches: Batches) -> Batches:
    """The block of a partition of links (a, b, w), each at both ends."""
    links = list(batches)
    if not sum(x.num_rows for x in links):
        return
    links = pa.Table.from_batches(links)
    a, b, w = (links.column(x).to_numpy() for x in "abw")
    del links
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    del order
    ids, ends = np.unique(a, return_inverse=True)
    n, loops = len(ids), a == b
    loop = np.bincount(ends[loops], w[loops], n)
    k = np.bincount(ends, w, n) + loop
    apart = ~loops
    ends, b, w = ends[apart], b[apart], w[apart]
    cells = (ids.astype(np.int32), np.bincount(ends, minlength=n).astype(np.int32), b.astype(np.int32), w if (w != 1).any() else w[:0], k, loop if loops.any() else loop[:0])
    yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in cells], schema=_BLOCK)


def _blocks(batches: Batches) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, ends, far, weights or None, k, loop) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            cell = {x: batch.column(x)[i] for x in batch.schema.names}
            ids, degree, far = (_array(cell[x], np.int32) for x in ("ids", "degree", "far"))
            w, k, loop = (_array(cell[x], np.float64) for x in ("w", "k", "loop"))
            yield ids, np.repeat(np.arange(len(ids)), degree), far, w if len(w) else None, k, loop if len(loop) else np.zeros(len(ids))


def _chosen(shared, names, m, resolution: float, seed: int, turn: int, same: float) -> Callable[[Batches], Batches]:  # noqa: ANN001
    """The moves of a round's blocks."""

    def chosen(batches: Batches) -> Batches:
        c, total, receives = shared.value
        label, weight = _Names(names.value if names is not None else None), m.value
        for ids, ends, far, w, k, loop in _blocks(batches):
            at, every = c[ids], weight[ids] if np.ndim(weight) else np.full(len(ids), weight)
            go, to, into, wants = small_community.choices(ends, c[far], w, at, label, total, k, every, resolution, seed, turn, same, receives)
            worth = small_community.worth(into, loop, total[at], k, every, resolution)
            yield pa.record_batch([pa.array([ids[go].tobytes()], pa.binary()), pa.array([to.astype(np.int32).tobytes()], pa.binary()), pa.array([float(worth.sum())]), pa.array([len(go)], pa.int64()), pa.array([wants], pa.int64())], schema=_MOVED)

    return chosen


class _Names:
    """The numbers of communities by their places, which are the same where no names are given."""

    def __init__(self, names: np.ndarray | None) -> None:
        self.names = names

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return at if self.names is None else self.names[at]


def _between(shared, width: int) -> Callable[[Batches], Batches]:  # noqa: ANN001
    """Links between communities, each once, summed by block."""

    def between(batches: Batches) -> Batches:
        c = shared.value
        for ids, ends, far, w, _, loop in _blocks(batches):
            near, to = c[ids][ends], c[far]
            # both ways of a link within a community are seen, and each counts for half
            some = np.flatnonzero(near <= to)
            a, b, weight = small_community.summed(near[some], to[some], None if w is None else w[some], width)
            weight = np.where(a == b, weight / 2, weight)
            loops = np.flatnonzero(loop)
            own = c[ids[loops]].astype(np.int64)
            table = pa.table({"a": np.concatenate([a, own]), "b": np.concatenate([b, own]), "w": np.concatenate([weight, loop[loops]])}, schema=_LINKS)
            yield from table.to_batches(1 << 16)

    return trimmed(between)


def _lowest(shared) -> Callable[[Batches], Batches]:  # noqa: ANN001
    """Nodes with a neighbour in their community of a lower root, and that root."""

    def lowest(batches: Batches) -> Batches:
        c, root = shared.value
        for ids, ends, far, *_ in _blocks(batches):
            inside = np.flatnonzero(c[ids][ends] == c[far])
            low = root[ids].copy()
            np.minimum.at(low, ends[inside], root[far[inside]])
            less = np.flatnonzero(low < root[ids])
            yield pa.record_batch([pa.array([ids[less].tobytes()], pa.binary()), pa.array([low[less].tobytes()], pa.binary())], schema=_LOW)

    return lowest


def _named(shared) -> Callable[[Batches], Batches]:  # noqa: ANN001
    def named(batches: Batches) -> Batches:
        c = shared.value
        for ids, *_ in _blocks(batches):
            yield from pa.table({"id": ids.astype(np.int64), "c": c[ids].astype(np.int64)}, schema=_IDS).to_batches(1 << 16)

    return named


class Blocks:
    """The links (a, b, w) of nodes numbered from 0 to below ``n`` in blocks.

    ``names`` are the numbers by which chance is drawn, of all nodes; without them the nodes' own. ``m`` is the weight of all links that counts for
    a node, one for all or one for each.
    """

    def __init__(self, linked: DataFrame, n_links: int, n: int, m: float | np.ndarray, names: np.ndarray | None = None) -> None:
        self.spark: SparkSession = linked.sparkSession
        ship_package(self.spark)
        self.n, self.m, self.names = n, m, names
        ways = linked.unionByName(linked.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        ways = ways.select("a", "b", "w").repartition(max(1, -(-2 * n_links // BLOCK_LINKS)), "a")
        self.rows = ways.mapInArrow(trimmed(_built), BLOCK).persist()
        self.k = np.zeros(n)
        for r in self.rows.select("ids", "k").toArrow().to_batches():
            for ids, k in zip(r.column("ids"), r.column("k"), strict=True):
                self.k[_array(ids, np.int32)] = _array(k, np.float64)
        if self.k.sum() < 1 << 31:
            self.k = self.k.astype(np.int32)
        self.sent = [self._send(m), None if names is None else self._send(names)]

    def _send(self, value):  # noqa: ANN001, ANN202
        return self.spark.sparkContext.broadcast(value)

    def _told(self, value, task: Callable, schema: str) -> Iterator[dict]:  # noqa: ANN001
        shared = self._send(value)
        try:
            yield from (dict(zip(b.schema.names, row, strict=True)) for b in self.rows.mapInArrow(task(shared), schema).toArrow().to_batches() for row in zip(*b.columns, strict=True))
        finally:
            shared.destroy()

    def begin(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state of nodes in communities ``c``: these, and the sums of the nodes' weights."""
        return c.astype(np.int32), np.bincount(c, self.k, self.n).astype(self.k.dtype)

    def step(self, state: tuple[np.ndarray, np.ndarray], turn: int, resolution: float, seed: int, same: float) -> tuple[tuple[np.ndarray, np.ndarray], Row]:
        """(state after a round, figures of the state before it)."""
        c, total = state
        names = np.arange(self.n) if self.names is None else self.names
        receives = np.concatenate([small_community.xxhash64((seed, turn // 2), names[i : i + (1 << 20)]) % 2 == turn % 2 for i in range(0, self.n, 1 << 20)])
        del names
        new, sums = c.copy(), total.copy()
        values, moves, wants = [], 0, 0
        for r in self._told((c, total, receives), lambda shared: _chosen(shared, self.sent[1], self.sent[0], resolution, seed, turn, same), MOVED):
            go, to = _array(r["node"], np.int32), _array(r["to"], np.int32)
            np.subtract.at(sums, c[go], self.k[go])
            np.add.at(sums, to, self.k[go])
            new[go] = to
            values.append(r["value"].as_py())
            moves, wants = moves + r["moves"].as_py(), wants + r["wants"].as_py()
        return (new, sums), Row(value=round(sum(values), 12) if values else None, moves=moves, wanting=wants)

    def links_between(self, c: np.ndarray, width: int) -> DataFrame:
        """Links (a, b, w) between the communities ``c``, which are below ``width``."""
        self.sent.append(shared := self._send(c.astype(np.int32)))
        return self.rows.mapInArrow(_between(shared, width), "a long, b long, w double").groupBy("a", "b").agg(F.sum("w").alias("w"))

    def connected(self, c: np.ndarray) -> np.ndarray:
        """The smallest node that each node reaches within its community."""
        root = np.arange(self.n, dtype=np.int32)
        while True:
            new = root.copy()
            for r in self._told((c, root), _lowest, "node binary, low binary"):
                node, low = _array(r["node"], np.int32), _array(r["low"], np.int32)
                np.minimum.at(new, node, low)
                np.minimum.at(new, root[node], low)
            if (new == root).all():
                return root
            while not ((low := new[new]) == new).all():
                new = low
            root = new

    def named(self, c: np.ndarray) -> DataFrame:
        """(id, c) of the nodes with links."""
        self.sent.append(shared := self._send(c.astype(np.int32)))
        return self.rows.mapInArrow(_named(shared), "id long, c long")

    def close(self) -> None:
        self.rows.unpersist()
        for x in self.sent:
            if x is not None:
                x.destroy()
