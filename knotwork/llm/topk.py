"""Operator 5: exact top-k inner products with a pivot-distance index.

Vectors are quantised to integers. Each is keyed by its nearest pivot p and its distance r from it; the distances of a pivot
are cut into annuli at quantiles. Of each cell (pivot, annulus) the index knows the range [r1, r2] of distances, the range
[m, M] of norms and the number of vectors. For a query q no vector x of a cell has a larger product than

    (|q|^2 + M^2 - gap^2) / 2,   gap = distance of |q - p| from [r1, r2]   (triangle inequality: |q - x| >= | |q - p| - r |)
    |q| M                                                                  (Cauchy-Schwarz)
    <q, p> + max over t of a t + b sqrt(r2^2 - t^2)                        (x - p split along p and across it)

with a, b the parts of q along and across p, and t = <x - p, p> / |p| in the range that distances and norms leave. A query
expands cells in order of their bounds, in rounds: first until they hold more than k vectors, then ever more, by ``GROW``.
After each round its k-th best score is known, and it stops at the first cell whose bound is below it. All arithmetic on scores is exact
in integers.

Scale. Pivots grow with the square root of the table up to ``PIVOTS``, so the index has a bounded size. Cells are packed into
shelves of about ``BLOCK`` vectors, cells of neighbouring pivots together; a larger cell, such as thousands of equal vectors, becomes
several blocks. Queries near the same pivots form batches of about ``QUERIES``. In a round only shelves that a batch
asks for move to it, each at most once in all rounds, and within a shelf only the cells that a query asks for are multiplied.
For a given number of queries the rows moved grow with the table; where no bound excludes cells, as among random vectors
of many dimensions, the work is that of all products.

Defined results. Vectors that are null or hold null or non-finite components take no part, neither as query nor as
candidate; vectors of different lengths are compared as if padded with zeros; an empty vector scores 0. Ties go to the
smaller vec_id, then to equal rows in any order. A null vec_id is no query; as a candidate it comes after others of its
score. Rows equal in id and vector are one query, and not their own candidates; rows that share an id but not the vector are
queries of their own (their results carry the same query_id) and candidates of each other. Fewer than k candidates: all of them. An empty table of vectors or queries: an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.runtime import cut, give_back, release, ship_package

SCALE = 1024
#: The most pivots; annuli of a pivot.
PIVOTS, ANNULI = 1024, 6
#: Rows that pivots and quantiles are drawn from (by a hash of the id); vectors of a shelf, queries of a batch, at least and by
#: vector components; queries multiplied at once.
SAMPLE, BLOCK, QUERIES, VALUES, ROWS = 4096, 16_384, 2048, 1 << 21, 256
#: How many times the vectors of all rounds so far a query may expand in the next one.
GROW = 16
#: Slack for rounding in distances (exact scores never pass through it).
SLACK = 1e-6
NULL_ID = 2**63 - 1
LEAST = -(2**63)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): floor(scale * x) of the usable vectors, components as double first."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("q"))


def packed(column: pa.Array) -> pa.Array:
    """Lists of integers as bytes: the size of an integer in bytes, then the integers of that size."""
    values, bounds = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.list_value_length(column).to_numpy()])
    low, high = values.min(initial=0), values.max(initial=0)
    size = next(s for s in (2, 4, 8) if -(1 << (8 * s - 1)) <= low and high < 1 << (8 * s - 1))
    data, mark = values.astype(f"<i{size}").tobytes(), bytes([size])
    return pa.array([mark + data[a * size : b * size] for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())


def matrix(rows: list[bytes]) -> np.ndarray:
    """Rows from ``packed``, padded with zeros."""
    kinds = {(len(r), r[0]) for r in rows}
    if len(kinds) == 1:
        size = kinds.pop()[1]
        flat = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)[:, 1:]
        return np.ascontiguousarray(flat).view(f"<i{size}").astype(np.int64)
    out = np.zeros((len(rows), max(((n - 1) // size for n, size in kinds), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : (len(r) - 1) // r[0]] = np.frombuffer(r, f"<i{r[0]}", offset=1)
    return out


def _padded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    x, p = (a.astype(np.float64) for a in _padded(x, p))
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * x @ p.T))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where no sum can reach 2^53."""
    a, b = _padded(a, b)
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Far apart vectors of the sample, greedily from its first row, then put in an order where neighbours are near."""
    pivots = [sample[0]]
    near = _distances(sample, sample[:1])[:, 0]
    while len(pivots) < n and near.max() > 0:
        pivots.append(sample[near.argmax()])
        near = np.minimum(near, _distances(sample, pivots[-1][None])[:, 0])
    apart = _distances(np.stack(pivots), np.stack(pivots))
    chain, left = [0], set(range(1, len(pivots)))
    while left:
        chain.append(min(left, key=lambda i: apart[chain[-1], i]))
        left.remove(chain[-1])
    return np.stack([pivots[i] for i in chain])


def bounds(q: np.ndarray, pivots: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """For each query and cell (cell, r1, r2, m, M, count): no vector in it has a larger product."""
    at = (cells[:, 0] // ANNULI).astype(int)
    r1, r2, m, M = cells[:, 1:5].T
    q, p = (a.astype(np.float64) for a in _padded(q, pivots))
    norm, size = np.sqrt((q**2).sum(1))[:, None], np.sqrt((p**2).sum(1))[at]
    dot, d = (q @ p.T)[:, at], _distances(q, p)[:, at]
    gap = np.maximum(0, np.maximum(r1 - d, d - r2) - SLACK * (1 + d))
    out = np.minimum((norm**2 + M**2 - gap**2) / 2, norm * M)
    with np.errstate(divide="ignore", invalid="ignore"):
        along = np.where(size > 0, dot / size, 0)
        t1, t2 = (np.where(size > 0, x / (2 * size), s * r2) for x, s in ((m**2 - size**2 - r2**2, -1), (M**2 - size**2 - r1**2, 1)))
        best = np.where(norm > 0, r2 * along / norm, 0)
    slack = SLACK * (1 + r2 + M + size)
    t = np.clip(best, np.maximum(t1 - slack, -r2), np.maximum(np.minimum(t2 + slack, r2), -r2))
    across = np.sqrt(np.maximum(0, norm**2 - along**2))
    out = np.minimum(out, dot + along * t + across * np.sqrt(np.maximum(0, r2**2 - t**2)) + slack * (1 + norm))
    return out + SLACK * (1 + np.abs(out))


def shelves(cells: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The shelf of each cell, and the blocks of each shelf; cells come in an order where neighbours are near."""
    shelf, blocks, room = np.zeros(len(cells), np.int64), [], 0
    for i, n in enumerate(cells[:, 5].astype(int)):
        if not blocks or n > room:
            blocks.append(-(-n // block))
            room = block if n <= block else 0
        shelf[i] = len(blocks) - 1
        room = max(0, room - n)
    return shelf, np.array(blocks)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, products_made: list[int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each of ``queries`` (both vec_id, embedding).

    ``products_made``, if given, gets the number of products of each round, for measurements.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    result = "query_id long, rank int, vec_id long, score long"
    # a null id is kept as the largest number, which sorts it last, until the end
    data = quantised(vectors).withColumn("vec_id", F.coalesce("vec_id", F.lit(NULL_ID)))
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], result)
    drawn = matrix(packed(sample.column("q").combine_chunks()).to_pylist())
    pivots = choose_pivots(drawn, max(1, min(PIVOTS, len(drawn) // 4, int(2 * vectors.count() ** 0.5))))
    d = _distances(drawn, pivots)
    nearest, least = d.argmin(1), d.min(1)
    cuts = np.stack([np.quantile(least[nearest == p], np.arange(1, ANNULI) / ANNULI) if (nearest == p).any() else np.zeros(ANNULI - 1) for p in range(len(pivots))])
    index = spark.sparkContext.broadcast((pivots, cuts))  # of bounded size
    width = max(1, drawn.shape[1])
    block, batch = (max(1, min(n, VALUES // width)) for n in (BLOCK, QUERIES))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cuts = index.value
        for big in batches:
            for lo in range(0, big.num_rows, 2048):
                b = big.slice(lo, 2048)
                v = packed(b.column("q"))
                x = matrix(v.to_pylist())
                d = _distances(x, pivots)
                near, r = d.argmin(1), d.min(1)
                cell = near * ANNULI + (r[:, None] > cuts[near]).sum(1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), v, pa.array(cell.astype(np.int32)), pa.array(r), pa.array(_norms(x))], names=["vec_id", "v", "cell", "r", "norm"])

    schema = "vec_id long, v binary, cell int, r double, norm double"
    placed = cut(data.mapInArrow(place, schema))
    summary = placed.groupBy("cell").agg(F.min("r"), F.max("r"), F.min("norm"), F.max("norm"), F.count("*")).collect()  # at most PIVOTS * ANNULI rows
    cells = np.array(sorted(map(tuple, summary)), np.float64).reshape(-1, 6)
    shelf, blocks = shelves(cells, block)
    known = spark.sparkContext.broadcast((cells, shelf, blocks))  # of bounded size
    where = spark.createDataFrame([(int(c), int(s), int(blocks[s])) for c, s in zip(cells[:, 0], shelf, strict=True)], "cell int, shelf int, blocks int")
    stored = placed.join(F.broadcast(where), "cell").select("shelf", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "cell", "vec_id", "v")
    asking = quantised(queries.where(F.col("vec_id").isNotNull())).dropDuplicates(["vec_id", "q"]).mapInArrow(place, schema)
    # a query is known by its id and a hash of its vector, which tells rows of one id apart
    asking = cut(asking.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("mark"), "v", (F.col("cell") / ANNULI).cast("int").alias("pivot")))
    counts = {r.pivot: r["count"] for r in asking.groupBy("pivot").count().collect()}  # at most PIVOTS rows
    first, spread = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)
    full, here = 0, 0
    for p in sorted(counts):  # batches hold the queries of neighbouring pivots
        if here and here + counts[p] > batch:
            full, here = full + 1, 0
        first[p], spread[p] = full, -(-counts[p] // batch)
        full, here = (full, here + counts[p]) if spread[p] == 1 else (full + spread[p], 0)
    n_all = float(cells[:, 5].sum())

    def visits(low: int, high: int):
        """The cells that each query expands in a round, by shelf and block; a row of shelf -1 if more remain."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for lo in range(0, big.num_rows, ROWS):
                    yield visit(big.slice(lo, ROWS))

        def visit(b: pa.RecordBatch) -> pa.RecordBatch:
            cells, shelf, blocks = known.value
            ids, pivot = (b.column(c).to_numpy() for c in ("query_id", "pivot"))
            bound = bounds(matrix(b.column("v").to_pylist()), index.value[0], cells)
            order = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(cells[order, 5], axis=1) - cells[order, 5]
            floor = b.column("kth").fill_null(LEAST).to_numpy()
            open_ = np.take_along_axis(bound, order, 1) >= floor[:, None]
            row, col = np.nonzero(open_ & (before >= low) & (before < high))
            cell = order[row, col]
            by = np.lexsort((cell, shelf[cell], row))
            row, cell = row[by], cell[by]
            s = shelf[cell]
            start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (s[1:] != s[:-1])])) if len(row) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)), pa.int32()), pa.array(cells[cell, 0].astype(np.int32)))
            n = blocks[s[start]]
            at = np.repeat(np.arange(len(start)), n)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            more = np.flatnonzero((open_ & (before >= high)).any(1))
            group = first[pivot] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % spread[pivot]
            who = np.concatenate([row[start][at], more])
            none = pa.nulls(len(more), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([s[start][at], np.full(len(more), -1)]).astype(np.int32)), pa.array(np.concatenate([nth, np.zeros(len(more), np.int64)]).astype(np.int32)), pa.array(group[who]), pa.array(ids[who]), b.column("mark").take(pa.array(who)), b.column("v").take(pa.array(who)), pa.concat_arrays([lists.take(pa.array(at)), none])],
                names=["shelf", "block", "batch", "query_id", "mark", "v", "cells"],
            )

        return run

    def compare(q: pa.Table, x: pa.Table) -> pa.Table:
        try:
            return best_of(q, x)
        finally:
            give_back()

    def best_of(q: pa.Table, x: pa.Table) -> pa.Table:
        """The k best of a block for each query that asks for any of its cells."""
        out = [np.zeros((4, 0), np.int64)]
        if q.num_rows and x.num_rows:
            x = x.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
            ids, cell = x.column("vec_id").to_numpy(), x.column("cell").to_numpy()
            X, Q, who = matrix(x.column("v").to_pylist()), matrix(q.column("v").to_pylist()), q.column("query_id").to_numpy()
            mark, copies = q.column("mark").to_numpy(), (q.column("v"), x.column("v"))
            held, start = np.unique(cell, return_index=True)
            end = np.append(start[1:], len(cell))
            lists = q.column("cells").combine_chunks()
            owner = np.repeat(np.arange(q.num_rows), pc.list_value_length(lists).to_numpy())
            spot = np.searchsorted(held, lists.flatten().to_numpy())
            there = (spot < len(held)) & (held[np.minimum(spot, len(held) - 1)] == lists.flatten().to_numpy())
            asks = np.zeros((q.num_rows, len(held)), bool)
            asks[owner[there], spot[there]] = True
            for lo in range(0, q.num_rows, ROWS):
                mine = asks[lo : lo + ROWS]
                s = np.full((len(mine), len(ids)), LEAST)
                if mine.mean() > 0.5:
                    s = np.where(np.repeat(mine, end - start, axis=1), products(Q[lo : lo + ROWS], X), LEAST)
                else:
                    for c in np.flatnonzero(mine.any(0)):
                        rows = np.flatnonzero(mine[:, c])
                        s[rows, start[c] : end[c]] = products(Q[lo + rows], X[start[c] : end[c]])
                for row, col in np.argwhere(who[lo : lo + ROWS, None] == ids[None]):
                    if copies[0][lo + int(row)] == copies[1][int(col)]:
                        s[row, col] = LEAST
                kth = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(s), LEAST)
                row, col = np.nonzero((s >= kth[:, None]) & (s > LEAST))
                by = np.lexsort((ids[col], -s[row, col], row))
                row, col = row[by], col[by]
                begin = np.searchsorted(row, np.arange(len(s)))
                keep = np.arange(len(row)) - begin[row] < k
                out.append(np.stack([who[lo + row[keep]], mark[lo + row[keep]], ids[col[keep]], s[row[keep], col[keep]]]))
        found = np.concatenate(out, axis=1)
        return pa.table({"query_id": found[0], "mark": found[1], "vec_id": found[2], "score": found[3]})

    by = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    best = spark.createDataFrame([], "query_id long, mark long, vec_id long, score long, rank int")
    low, high = 0, k + 1
    while True:
        kth = best.where(F.col("rank") == k).select("query_id", "mark", F.col("score").alias("kth"))
        asked = cut(asking.join(kth, ["query_id", "mark"], "left").select("query_id", "mark", "v", "pivot", "kth").mapInArrow(visits(low, high), "shelf int, block int, batch long, query_id long, mark long, v binary, cells array<int>"))
        now = asked.where("shelf >= 0")
        if not now.isEmpty():
            if products_made is not None:
                sizes = spark.createDataFrame([(int(c[0]), int(c[5])) for c in cells], "cell int, n long")
                products_made.append(now.where("block = 0").select(F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell").agg(F.sum("n")).first()[0])
            keys = ["shelf", "block", "batch"]
            moved = stored.join(now.select(*[F.col(c).alias(c) for c in keys]).distinct(), ["shelf", "block"]).select(*[F.col(c).alias(c) for c in (*keys, "cell", "vec_id", "v")])
            # a fixed number, since the work of a group is not that of its bytes
            left, right = (t.repartition(parts, *keys).groupBy(*keys) for t in (now, moved))
            found = left.cogroup(right).applyInArrow(compare, "query_id long, mark long, vec_id long, score long")
            best = cut(best.drop("rank").unionByName(found).withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k))
            release(spark)
        if high > n_all or asked.where("shelf < 0").isEmpty():
            break
        low, high = high, high * GROW
    return best.select("query_id", "rank", F.nullif("vec_id", F.lit(NULL_ID)).alias("vec_id"), "score")
