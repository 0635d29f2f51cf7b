"""Operator 4: a quality classifier as a factorisation machine.

A document becomes a sparse vector of hashed words, structure statistics (raw and in bins) and metadata (its stated
number of characters, in bins). The model scores

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

in time linear in the non-zero entries (the sum-of-squares identity of Rendle 2010), so all pairwise interactions
count without being formed. Labels, language, source and id are never inputs.

Training uses a bounded sample: the ``SAMPLE`` labelled rows outside the held-out quarter whose ids hash lowest. Only
their ids are broadcast (a bounded number); features are computed by the executors over whole texts; the driver fits
the model of fixed size by mini-batch Adam with a fixed seed. Scoring is one pass over the documents, no shuffle.

Defined results. Null or empty text: scored by its statistics as the empty text. Null n_chars: a bin of its own. Null
doc_id: not held out, scored. No usable labels: every score is 0.5; labels of one class only: scores come near it.
Repeated rows are scored each; extra columns are ignored. Texts of any length are read whole. Equal hashes in the choice of
the sample go by id. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.runtime import ship_package, trimmed

SAMPLE = 4096
WORD_DIMS = 2048
BINS = 12
RANK = 8
THRESHOLD = 0.7
STATS = ("upper", "punct", "digits", "distinct", "word_len", "line_dup", "length", "top_word", "marks", "bars", "wide")
CHAR_BINS = 24
DIMS = WORD_DIMS + len(STATS) * (1 + BINS) + CHAR_BINS + 1

_UPPER, _LOWER, _DIGIT, _WHITE, _MARK, _BAR, _HIGH = (np.zeros(256, bool) for _ in range(7))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = _HIGH[128:] = True
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MARK[[ord(c) for c in "!#$%&*"]] = True
_BAR[[ord(c) for c in "|<>{}[]=_~^\\"]] = True
_PUNCT = ~(_UPPER | _LOWER | _DIGIT | _WHITE | _HIGH)
_KINDS = np.stack([_UPPER, _LOWER, _DIGIT, _WHITE, _MARK, _BAR, _HIGH, _PUNCT]).astype(np.float64)


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (sorted, distinct) and values of a document's entries."""
    text = text or ""
    words = Counter(text.split())
    n, distinct = words.total(), len(words)
    upper, lower, digit, white, mark, bar, high, punct = _KINDS @ np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    solid = max(1.0, upper + lower + digit + high + punct)
    lines = [x for x in text.split("\n") if x]
    stats = np.array([
        upper / max(1.0, upper + lower),
        punct / solid,
        digit / solid,
        distinct / max(1, n),
        min(1.0, solid / max(1, n) / 24),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, np.log2(n + 1) / 16),
        max(words.values(), default=0) / max(1, n),
        min(1.0, 4 * mark / solid),
        min(1.0, 4 * bar / solid),
        high / solid,
    ])
    size = -1 if n_chars is None else min(CHAR_BINS - 1, max(0, int(n_chars)).bit_length())
    k = np.fromiter(words.values(), np.float64, distinct)
    at = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.int64, distinct) % WORD_DIMS
    bag = np.bincount(at, k, WORD_DIMS) if distinct else np.zeros(WORD_DIMS)
    idx = np.flatnonzero(bag)
    val = np.sqrt(bag[idx])
    val *= 0.5 / max(1e-9, np.sqrt(val @ val))
    base = WORD_DIMS + len(STATS)
    bins = base + np.arange(len(STATS)) * BINS + np.minimum(BINS - 1, (stats * BINS).astype(int))
    return np.concatenate([idx, np.arange(WORD_DIMS, base), bins, [base + len(STATS) * BINS + 1 + size]]), np.concatenate([val, stats, np.full(len(STATS) + 1, 0.5)])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probabilities of label 1 of sparse rows; every row has at least one entry."""
        idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        weighted = self.factors[idx] * val[:, None]
        total = np.add.reduceat(weighted, starts, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", weighted, weighted), starts)
        z = self.bias + np.add.reduceat(self.linear[idx] * val, starts) + 0.5 * ((total**2).sum(1) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 42) -> FactorisationMachine:
        """Minimise the logistic loss over dense rows ``x`` by Adam; deterministic for the same rows in the same order."""
        rng = np.random.default_rng(seed)
        p = [np.zeros(1), np.zeros(x.shape[1]), rng.normal(0, 0.05, (x.shape[1], RANK))]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                b = order[lo : lo + batch]
                xb = x[b].astype(np.float64)
                s = xb @ p[2]
                sq = xb**2
                z = p[0] + xb @ p[1] + 0.5 * ((s**2).sum(1) - (sq @ p[2] ** 2).sum(1))
                e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[b]) / len(b)
                g = [np.array([e.sum()]), xb.T @ e + decay * p[1], xb.T @ (e[:, None] * s) - p[2] * (sq.T @ e)[:, None] + decay * p[2]]
                t += 1
                for i in range(3):
                    m[i] = 0.9 * m[i] + 0.1 * g[i]
                    v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
                    p[i] = p[i] - rate * (1 - epoch / epochs) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return cls(float(p[0][0]), p[1], p[2])


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the quarter that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled documents (twice that where ids repeat)."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"),
                "quality": b.column("quality"),
                "idx": pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                "val": pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32())),
            })

    wanted = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", "n_chars")
    got = wanted.mapInArrow(trimmed(vectors), "doc_id long, quality int, idx array<int>, val array<float>").limit(2 * sample).collect()
    got.sort(key=lambda r: (r.doc_id, r.quality, r.idx))
    y = np.array([r.quality for r in got], np.float64)
    if not len(y):
        return FactorisationMachine(0.0, np.zeros(DIMS), np.zeros((DIMS, RANK)))
    x = np.zeros((len(got), DIMS), np.float32)
    for i, r in enumerate(got):
        x[i, r.idx] = r.val
    return FactorisationMachine.fit(x, y)


def scored(docs: DataFrame, model: FactorisationMachine, *keep: str, name: str = "score") -> DataFrame:
    """The ``keep`` columns of every document with its score under ``name``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    x = docs.select(*keep, F.col("text").alias("__text"), F.col("n_chars").cast("long").alias("__n_chars"))
    schema = x.select(*keep).schema.add(name, "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                b = big.slice(lo, 512)
                rows = [features(t, n) for t, n in zip(b.column("__text").to_pylist(), b.column("__n_chars").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(shared.value.scores(rows))], names=[*keep, name])

    return x.mapInArrow(trimmed(score), schema)


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    ship_package(docs.sparkSession)
    x = scored(docs, train(docs, labels), "doc_id")
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, all columns unchanged."""
    ship_package(docs.sparkSession)
    keep = docs.columns
    return scored(docs, train(docs, labels), *keep, name="__score").where(F.col("__score") >= threshold).select(*keep)
