"""Operator 2: near-duplicate embeddings by sorted projection passes.

Equal vectors of a label form one class, so copies cost nothing. In each pass a class gets the concatenated bits of random
hyperplane hashes, with planes through the centre of its label; classes are ordered by (label, bits), and each is compared with
the ``WINDOW`` that follow it, by matrix products over the sorted stream. The last rows of a range meet the first of the next one,
so range borders lose nothing. Rows carry their vector as 16-bit integers with the exact length of the rounding error: pairs
above the threshold beyond that error are united inside the task, and only a spanning forest of them leaves it; the few
pairs inside the error are compared in double precision afterwards.

Passes follow the size of the largest label. Two classes at the threshold fall on the same side of a plane with probability
p = 1 - arccos(0.93) / pi, so among n classes they share a window in about p ^ log2(n / WINDOW) of all passes, and ``planned`` takes as many as
find such a pair with probability ``RECALL``. That holds for spread labels; whether it holds for a given table is measured:
the second half of the passes tells by what it adds to the first how many links both miss, and passes are doubled until that is
below 1 - RECALL. Work and shuffle therefore grow as n ^ 1.2 for spread labels, in rounds of ``ROUND`` passes whose shuffle files are
given back.

Then n_links is counted exactly inside each component, in pairs of blocks of bounded size. There rows lie in order of
projections, so that tiles are compact: by their centres and radii (|a - b|^2 = 2 - 2 cos for unit vectors) tiles too far apart are
left out, tiles so near that all pairs link are counted without products, and the others are multiplied in single precision, pairs within its
error of the threshold again in double. Only counts leave a task, so large groups of near copies never emit their pairs. Components of
two classes need no comparison. A row is shuffled once for every block of its component.

Defined results. Vectors that are null, zero, or hold null or non-finite components, and null labels: no links, the row's
own component. Vectors of different lengths do not link. Null vec_id: counts as a link of others; it is smaller than no
id, and a row alone with it has a null component and is not kept. Repeated rows are vectors of their own. Ties do not arise: a
component's id is its smallest vec_id. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.components import components, stars
from knotwork.runtime import cut, give_back, release, ship_package, trimmed

THRESHOLD = 0.93
BITS, WINDOW, RECALL = 48, 256, 0.999
#: Passes of one round.
ROUND = 4
#: Vectors that centres of labels are drawn from, and the fewest of a label that give one.
SAMPLE, CENTRE = 4096, 8
#: Rows and vector components in a block of the exact counts; a row is shuffled once for every block of its component.
BLOCK, BLOCK_VALUES = 32_768, 1 << 21
TILE = 256
SEED = 7


def _rows(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors have one length; nearly always the batch itself."""
    n = pc.list_value_length(batch.column("v")).to_numpy()
    for k in np.unique(n):
        yield batch.filter(pa.array(n == k))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches by the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def classes(vectors: DataFrame) -> DataFrame:
    """(label, v, rep, n, h1, h2): the distinct usable vectors of each label, smallest id, number of rows and hashes."""
    return _hashed(vectors).where("usable").groupBy("label", "v", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))


def _hashed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, usable, h1, h2); 128 bits of hashes stand for label and vector where rows meet their class."""
    v = F.col("embedding")
    usable = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.select("vec_id", "label", v.alias("v"), usable.alias("usable"), F.xxhash64("label", v).alias("h1"), F.xxhash64(F.lit(SEED), "label", v).alias("h2"))


def planned(n: int, window: int = WINDOW, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Passes that find a pair at the threshold among n spread vectors of a label with probability ``recall``; at least 2."""
    together = (1 - acos(threshold) / pi) ** max(0.0, log2(max(n, 1) / window))
    return 2 if together > 0.999 else max(2, ceil(log(1 - recall) / log(1 - together)))


def centres_of(reps: DataFrame) -> dict[tuple, np.ndarray]:
    """Mean unit vector of each label and length with ``CENTRE`` of a bounded sample at least."""
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("label", "v").toArrow()
    groups: dict[tuple, list[np.ndarray]] = {}
    for label, v in zip(sample.column("label").to_pylist(), sample.column("v").to_pylist(), strict=True):
        groups.setdefault((label, len(v)), []).append(np.array(v, float))
    return {k: _unit(np.stack(v)).mean(0) for k, v in groups.items() if len(v) >= CENTRE}


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as 16-bit integers, their scales, and the lengths of the rounding errors."""
    scale = (np.abs(x).max(1) / 32767).astype(np.float32)
    code = np.clip(np.rint(x / scale[:, None]), -32768, 32767).astype(np.int16)
    error = np.sqrt(((x - code * scale[:, None].astype(float)) ** 2).sum(1))
    return code, scale, (error * 1.001 + 1e-9).astype(np.float32)


def window_links(reps: DataFrame, passes: range, centres: dict | None = None, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(a, b, sure): links found by these passes over (label, v, rep): a spanning forest of each stretch, and pairs to compare."""
    spark = reps.sparkSession
    sent = spark.sparkContext.broadcast(centres or {})  # of bounded size

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple, np.ndarray] = {}
        for big in batches:
            for lo in range(0, big.num_rows, 1024):
                for b in _by_length(big.slice(lo, 1024)):
                    x = _unit(_rows(b.column("v")))
                    code, scale, error = coded(x)
                    body = pa.array([c.tobytes() for c in code], pa.binary())
                    from_centre = x.copy()
                    names = b.column("label").dictionary_encode()
                    for i, label in enumerate(names.dictionary.to_pylist()):
                        if (label, x.shape[1]) in sent.value:
                            from_centre[names.indices.to_numpy() == i] -= sent.value[label, x.shape[1]]
                    for p in passes:
                        if (p, x.shape[1]) not in planes:
                            planes[p, x.shape[1]] = np.random.default_rng([SEED, x.shape[1], p]).normal(size=(x.shape[1], BITS))
                        key = (from_centre @ planes[p, x.shape[1]] > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), b.column("label"), pa.array(key), b.column("rep"), pa.array(scale), pa.array(error), body], names=["pass", "label", "key", "rep", "scale", "error", "code"])

    label = reps.schema["label"].dataType.simpleString()
    vector = f"pass int, label {label}, rep long, scale float, error float, code binary"
    table = reps.select("label", "rep", "v").mapInArrow(trimmed(keyed), f"pass int, label {label}, key long, rep long, scale float, error float, code binary")
    order = ["pass", "label", "key", "rep"]
    carried = ["pass", "label", "rep", "scale", "error", "code"]

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, here, seen = None, TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                b = batch.slice(lo, 2048).select(carried)
                if seen < window:
                    yield border(b.slice(0, window - seen), here - 1, window + seen)
                seen += b.num_rows
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if held is not None else b
                yield found(*compare(b))
                held = b.slice(max(0, b.num_rows - window))
        if held is not None:
            yield border(held, here, window - held.num_rows)

    def border(b: pa.RecordBatch, at: int, nth: int) -> pa.RecordBatch:
        """Rows for the meeting of two ranges: last ones before, first ones behind."""
        none = [pa.nulls(b.num_rows, t) for t in (pa.int64(), pa.int64(), pa.bool_())]
        return pa.RecordBatch.from_arrays([*none, pa.array(np.full(b.num_rows, at, np.int32)), pa.array(np.arange(nth, nth + b.num_rows, dtype=np.int32)), *b.columns], names=["a", "b", "sure", "border", "nth", *carried])

    kinds = [reps.select("label").limit(0).toArrow().schema.field("label").type]

    def found(a: np.ndarray, b: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
        none = [pa.nulls(len(a), t) for t in (pa.int32(), pa.int32(), pa.int32(), *kinds, pa.int64(), pa.float32(), pa.float32(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure), *none], names=["a", "b", "sure", "border", "nth", *carried])

    def compare(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = pc.binary_length(b.column("code")).to_numpy() // 2
        width = int(lengths.max(initial=0))
        scale, error = b.column("scale").to_numpy(), b.column("error").to_numpy()
        x = np.zeros((b.num_rows, width), np.float32)
        for k in np.unique(lengths):
            mine = lengths == k
            x[mine, :k] = np.frombuffer(b"".join(b.column("code").filter(pa.array(mine)).to_pylist()), np.int16).reshape(-1, k) * scale[mine, None]
        codes = b.column("label").dictionary_encode().indices.to_numpy().astype(np.int64)
        group = (b.column("pass").to_numpy().astype(np.int64) * (codes.max(initial=0) + 1) + codes) * (width + 1) + lengths
        slack = 2.4e-7 * (width + 8)
        pairs, doubt = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
        for lo in range(0, len(x), 256):
            hi = min(len(x), lo + 256 + window)
            s = x[lo : lo + 256] @ x[lo:hi].T
            i, j = np.nonzero(s >= threshold - 3e-3)
            near = (j > i) & (j - i <= window) & (group[lo + i] == group[lo + j])
            i, j = i[near], j[near]
            band = error[lo + i] + error[lo + j] + 3 * error[lo + i] * error[lo + j] + slack
            # where vectors are too long for this slack, all pairs in reach of it are in doubt
            sure, open_ = s[i, j] >= threshold + band, np.abs(s[i, j] - threshold) < band
            pairs.append(np.stack([lo + i[sure], lo + j[sure]]))
            doubt.append(np.stack([lo + i[open_], lo + j[open_]]))
        rep = b.column("rep").to_numpy()
        root = roots(len(x), *np.concatenate(pairs, 1))
        moved = np.flatnonzero(root != np.arange(len(x)))
        p, q = np.concatenate(doubt, 1)
        p, q = (v[root[p] != root[q]] for v in (p, q))
        return np.concatenate([rep[moved], rep[p]]), np.concatenate([rep[root[moved]], rep[q]]), np.arange(len(moved) + len(p)) < len(moved)

    def meet(t: pa.Table) -> pa.Table:
        try:
            t = t.sort_by("nth").select(carried).combine_chunks()
            a, b, sure = compare(t.to_batches()[0])
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sure": pa.array(sure)})
        finally:
            give_back()

    out = cut(table.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(trimmed(slide), f"a long, b long, sure boolean, border int, nth int, {vector}"))
    release(spark)
    borders = out.where("border IS NOT NULL").groupBy("border").applyInArrow(meet, "a long, b long, sure boolean")
    return cut(out.where("border IS NULL").select("a", "b", "sure").unionByName(borders).where("a <> b").distinct())


def compared(pairs: DataFrame, reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose vectors reach the threshold in double precision."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [float(np.dot(*(_unit(np.array([v], float))[0] for v in (x, y)))) >= threshold for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    side = lambda end, v: reps.select(F.col("rep").alias(end), F.col("v").alias(v))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def links_of(reps: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW, recall: float = RECALL) -> tuple[DataFrame, int]:
    """(a, b): each class that is not the smallest of its component, and that one; and the number of passes made."""
    n = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    centres = centres_of(reps)

    def run(some: range) -> DataFrame:
        out = None
        for lo in range(some.start, some.stop, ROUND):
            x = window_links(reps, range(lo, min(some.stop, lo + ROUND)), centres, threshold, window)
            sure, doubt = x.where("sure").select("a", "b"), x.where("NOT sure").select("a", "b")
            x = sure if doubt.isEmpty() else sure.unionByName(compared(doubt, reps, threshold))
            out = x if out is None else out.unionByName(x)
        return out

    def united(links: DataFrame) -> tuple[DataFrame, int]:
        x = stars(links).select(F.col("u").alias("a"), F.col("v").alias("b"))
        return x, x.count()

    made = max(2, passes or planned(n, window, threshold, recall))
    if n <= window + 1:
        return united(run(range(1)))[0], 1  # a window holds a whole label
    links, before = united(run(range(-(-made // 2))))
    links, after = united(links.unionByName(run(range(-(-made // 2), made))))
    while True:
        missed = (after - before) / max(1, before)  # of a half: g / (1 - g) where the other adds g of all
        if missed**2 <= 1 - recall:
            return links, made
        before = after
        links, after = united(links.unionByName(run(range(made, 2 * made))))
        made *= 2


def linked_rows(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rep, links): rows linked to each class of (rep, v, n, component, of), ``of`` being the classes of its component; in parts."""
    width = F.size("v")
    blocks = F.greatest(F.ceil(F.col("of") / BLOCK), F.ceil(F.col("of") * width / BLOCK_VALUES), F.lit(1)).cast("int")
    x = members.withColumn("blocks", blocks).withColumn("at", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("component", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "at", "rep", "n", "v")
    tile = TILE

    def compare(table: pa.Table) -> pa.Table:
        try:
            return counts(table.combine_chunks())
        finally:
            give_back()

    def tiles_of(x: np.ndarray, rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Compact tiles of these rows, their centres and radii."""
        planes = np.random.default_rng([SEED, x.shape[1]]).normal(size=(x.shape[1], BITS))
        bits = (x[rows] - x[rows].mean(0)) @ planes > 0
        rows = rows[np.argsort(bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)), kind="stable")]
        tiles = [rows[i : i + tile] for i in range(0, len(rows), tile)]
        centres = np.array([x[t].mean(0) for t in tiles]).reshape(-1, x.shape[1])
        return tiles, centres, np.array([np.sqrt(((x[t] - c) ** 2).sum(1).max()) for t, c in zip(tiles, centres, strict=True)])

    def counts(table: pa.Table) -> pa.Table:
        rep, n, at = (table.column(c).to_numpy() for c in ("rep", "n", "at"))
        x = _unit(_rows(table.column("v").combine_chunks()))
        short = x.astype(np.float32)
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        error, reach = 2.4e-7 * (x.shape[1] + 8), np.sqrt(max(0.0, 2 - 2 * threshold))
        left, right = (tiles_of(x, np.flatnonzero(at == side)) if (at == side).any() else ([], np.zeros((0, x.shape[1])), np.zeros(0)) for side in (lo, hi))
        links = np.zeros(len(x), np.int64)
        for i, (a, centre, radius) in enumerate(zip(*left, strict=True)):
            apart = np.sqrt(((right[1] - centre) ** 2).sum(1))
            for j in np.flatnonzero(apart - radius - right[2] <= reach + 1e-6):
                if lo == hi and j < i:
                    continue
                b, same = right[0][j], lo == hi and j == i
                if apart[j] + radius + right[2][j] < reach - 1e-6:
                    links[a] += n[b].sum() - (n[a] if same else 0)
                    if not same:
                        links[b] += n[a].sum()
                    continue
                s = short[a] @ short[b].T
                hit = s >= threshold - error
                p, q = np.nonzero(hit & (s <= threshold + error))
                for k in range(0, len(p), 4096):
                    pk, qk = p[k : k + 4096], q[k : k + 4096]
                    hit[pk, qk] = np.einsum("ij,ij->i", x[a[pk]], x[b[qk]]) >= threshold
                if same:
                    np.fill_diagonal(hit, False)
                links[a] += (hit @ n[b].astype(np.float64)).astype(np.int64)
                if not same:
                    links[b] += (n[a].astype(np.float64) @ hit).astype(np.int64)
        return pa.table({"rep": rep, "links": links})

    groups = ["component", "lo", "hi"]
    # a fixed number, since the work of a group is the square of its bytes
    x = x.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), *groups)
    return x.groupBy(*groups).applyInArrow(compare, "rep long, links long")


def deduplicated(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label)."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    reps = cut(classes(rows).where(F.col("rep").isNotNull()))
    links, _ = links_of(reps, threshold, passes, window)
    united = cut(components(links).withColumnRenamed("id", "rep"))
    group = united.groupBy("component").agg(F.count("*").alias("of"))
    narrow = reps.select("rep", "n", "h1", "h2").join(united.join(group, "component"), "rep", "left")
    # the classes of a component of two are linked with each other
    narrow = cut(narrow)
    two = narrow.where(F.col("of") == 2).groupBy("component").agg(F.sum("n").alias("rows"))
    many = cut(linked_rows(reps.select("rep", "v").join(narrow.where(F.col("of") > 2).select("rep", "n", "component", "of"), "rep"), threshold)).groupBy("rep").agg(F.sum("links").alias("links"))
    facts = narrow.join(two, "component", "left").join(many, "rep", "left")
    others = F.coalesce("links", F.col("rows") - F.col("n"), F.lit(0)) + F.col("n") - 1
    facts = facts.select("h1", "h2", F.coalesce("component", "rep").alias("component"), others.alias("links"))
    x = _hashed(rows).select("vec_id", F.when(F.col("usable"), F.col("h1")).alias("h1"), F.when(F.col("usable"), F.col("h2")).alias("h2"))
    out = x.join(facts, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
