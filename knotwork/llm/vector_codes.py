"""Operator 11: codes of vectors by parts, over distinct parts.

Components become integers and each vector is cut into equal consecutive parts. Equal vectors form a class first, and the
parts of the classes are reduced to weighted distinct rows of (position, part), so copies cost nothing later. Weighted Lloyd
rounds run over these rows: the codebooks, of fixed size, are broadcast, a task sends one exact sum and count for each entry and
dimension, and the driver divides. Then every distinct part has its code and error; these are joined back to the parts of the classes, and
the classes to the vectors. All numbers are integers, so no order of summation matters.

Skew. Keys are counted before they meet anything. Parts, vectors and labels that hold a large share of all rows are joined by
broadcasting at most 1000 of them (see ``by_key``), the others by a shuffle; sums by label are aggregated before they are shuffled.

Defined results. Vectors that are null, empty, or hold null or non-finite components, or one of 4096 or more in magnitude (whose
squares could leave 64 bits), take no part; nor do vectors of another length than most have (ties: the longest). A length that the
number of parts does not divide: parts are as long as rounding up makes them, the last ones shorter or empty. Ties of
distance: the lower index. Fewer vectors than entries: as many entries as vectors. Repeated rows are vectors of their own; rows that
share a vec_id among the first come in order of their integers; null ids come last there. Null labels count as one label. Extra columns
are ignored. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.by_key import joined_by_key
from knotwork.runtime import cut, ship_package, trimmed

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LIMIT = 4096.0
SEED = 11
#: Distinct parts that are compared at once.
ROWS = 4096
Codebooks = list[np.ndarray]


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x, h1, h2) of the vectors that take part, all of the commonest length; 128 bits of hashes stand for x."""
    v = F.col("embedding")
    inside = lambda c: F.abs(c.cast("double")) < LIMIT
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & inside(c))
    # filters may be evaluated in any order, so the integers do not rely on them
    x = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(v, lambda c: F.when(inside(c), F.floor(c.cast("double") * scale).cast("int"))).alias("x"))
    best = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    x = x.where(F.size("x") == (best.d if best else 0))
    return x.select("vec_id", "label", "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(SEED), "x").alias("h2"))


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids; ``entries`` rows come to the driver."""
    first = [r.x for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()]
    width = -(-len(first[0]) // parts)
    return [np.array([x[p * width : (p + 1) * width] for x in first], np.int64).reshape(len(first), -1) for p in range(parts)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each row, ties to the lower index."""
    d = np.stack([((x - c) ** 2).sum(1) for c in book], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def _by_position(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Stretches of a batch of one position each, with their parts as a matrix."""
    for lo in range(0, batch.num_rows, ROWS):
        piece = batch.slice(lo, ROWS)
        pos = piece.column("pos").to_numpy()
        for p in np.unique(pos):
            b = piece.filter(pa.array(pos == p))
            yield int(p), b, b.column("part").flatten().to_numpy().astype(np.int64).reshape(b.num_rows, -1)


def _round(spark: SparkSession, distinct: DataFrame, books: Codebooks) -> Codebooks:
    """One assignment and update."""
    sent = spark.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        total, count = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for p, b, x in _by_position(batch):
                at, _ = nearest(x, books[p])
                w = b.column("w").to_numpy()
                np.add.at(total[p], at, x * w[:, None])
                np.add.at(count[p], at, w)
        rows = [(p, e, i, int(t[e, i]), int(c[e])) for p, (t, c) in enumerate(zip(total, count, strict=True)) for e in np.flatnonzero(c) for i in range(t.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["pos", "entry", "place", "s", "n"])

    per = distinct.mapInArrow(trimmed(sums), "pos long, entry long, place long, s long, n long").groupBy("pos", "entry", "place").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"), F.sum("n").alias("n"))
    new = [b.copy() for b in books]
    for r in per.collect():  # one row for each component of the codebooks
        new[r.pos][r.entry, r.place] = int(r.s) // r.n
    return new


def _coded(spark: SparkSession, distinct: DataFrame, books: Codebooks) -> DataFrame:
    """(pos, part, w, code, error) of the distinct parts."""
    sent = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, b, x in _by_position(batch):
                at, error = nearest(x, sent.value[p])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(error)], names=["pos", "part", "w", "code", "error"])

    return distinct.select("pos", "part", "w").mapInArrow(trimmed(assign), "pos int, part array<int>, w long, code int, error long")


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part; ``entries`` is at most 256."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = integers(vectors, scale)
    classes = cut(rows.groupBy("h1", "h2", "x").agg(F.count("*").alias("n")))
    total = classes.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = first_codebooks(rows, parts, entries)
    width = books[0].shape[1]
    pieces = F.array(*[F.slice("x", p * width + 1, width) for p in range(parts)])
    cells = classes.select("h1", "h2", "n", F.posexplode(pieces).alias("pos", "part"))
    distinct = cut(cells.groupBy("pos", "part").agg(F.sum("n").alias("w")))
    for _ in range(rounds):
        books = _round(spark, distinct, books)
    text = ",".join(str(v) for b in books for v in b.ravel().tolist())
    met = joined_by_key(cells, _coded(spark, distinct, books), ["pos", "part"], "w", total * parts)
    digits = F.lpad(F.lower(F.hex(F.col("code"))), 2, "0")
    each = met.groupBy("h1", "h2", "n").agg(F.array_sort(F.collect_list(F.struct("pos", digits.alias("c")))).alias("cs"), F.sum("error").alias("error"))  # ``parts`` rows a class
    each = cut(each.select("h1", "h2", "n", F.array_join("cs.c", "").alias("code"), "error"))
    out = cut(joined_by_key(rows.select("vec_id", "label", "h1", "h2"), each, ["h1", "h2"], "n", total).select("vec_id", "label", "code", "error"))
    labels = out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    return joined_by_key(out, labels, ["label"], "rows", total).select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
