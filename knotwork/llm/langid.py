"""Operator 8: language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. An n-gram of three letters is bound by permuting (rolling) the
vectors by their place and multiplying them; a document is the bundle (sum) of its n-grams; a language prototype is the
bundle of the unit vectors of its training documents. A document gets the language of the prototype with the largest
cosine (Joshi, Halseth and Kanerva 2016). Runs of other characters count as one blank, so n-grams see word borders.

Bundling is linear, so a chunk of documents is one matrix product: counts of n-grams by n-gram vectors.

Training takes a bounded sample: of every language the ``PER_LANGUAGE`` documents outside the held-out quarter whose
ids hash lowest (all where there are fewer), ``SAMPLE`` at most in all. Prototypes are summed by Spark, one row a language
and dimension; only they reach the driver.

Defined results. Null text, or text without letters: ``und`` with score 0. Nothing to learn from: ``und``, score 0. Ties:
the first language by code point. Null doc_id: not held out, not learned from. Repeated rows are predicted each. Texts of any length are
read whole. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.runtime import ship_package, trimmed

DIMS = 512
SEED = 2024
#: Documents that teach a language, and all of them together; parts in which a language is ranked.
PER_LANGUAGE, SAMPLE, SALTS, FAN = 600, 60_000, 256, 16
#: Documents, characters and n-grams of one matrix product.
CHUNK_DOCS, CHUNK_CHARS, CHUNK_GRAMS = 64, 400_000, 16_384


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the quarter that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@cache
def _letters() -> np.ndarray:
    """Code point -> code point of its lower-case letter, 0 for anything but letters."""
    return np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 0 for i in range(0x110000)], np.int32)


_VECTORS: dict[int, np.ndarray] = {}


def letter_vector(letter: int) -> np.ndarray:
    if len(_VECTORS) > 20_000:
        _VECTORS.clear()
    if letter not in _VECTORS:
        _VECTORS[letter] = np.random.default_rng([SEED, letter]).integers(0, 2, DIMS, np.int8) * 2 - 1
    return _VECTORS[letter]


def letters_of(text: str | None) -> np.ndarray:
    """The letters of a text between blanks (0); empty without letters."""
    codes = _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not codes.any():
        return codes[:0]
    codes = np.concatenate([[0], codes, [0]])
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


def bundle(texts: list[np.ndarray]) -> np.ndarray:
    """One vector a document, the sum of its n-gram vectors."""
    out = np.zeros((len(texts), DIMS), np.float32)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and hi - lo < CHUNK_DOCS and (size == 0 or size + len(texts[hi]) <= CHUNK_CHARS):
            size += len(texts[hi])
            hi += 1
        chunk = texts[lo:hi]
        alphabet, small = np.unique(np.concatenate(chunk), return_inverse=True)
        k, ends = len(alphabet), np.cumsum([len(t) for t in chunk])
        grams, counts, rows = [], [], []
        for i, end in enumerate(ends):
            s = small[end - len(chunk[i]) : end].astype(np.int64)
            if len(s) > 2:
                g, n = np.unique((s[:-2] * k + s[1:-1]) * k + s[2:], return_counts=True)
                grams.append(g), counts.append(n), rows.append(np.full(len(g), i))
        if grams:
            gram, at = np.unique(np.concatenate(grams), return_inverse=True)
            row, count = np.concatenate(rows), np.concatenate(counts)
            v = np.stack([letter_vector(int(a)) for a in alphabet])
            for first in range(0, len(gram), CHUNK_GRAMS):
                part, here = gram[first : first + CHUNK_GRAMS], (at >= first) & (at < first + CHUNK_GRAMS)
                table = np.zeros((len(chunk), len(part)), np.float32)
                table[row[here], at[here] - first] = count[here]
                bound = np.roll(v, 2, 1)[part // (k * k)] * np.roll(v, 1, 1)[part // k % k] * v[part % k]
                out[lo:hi] += table @ bound.astype(np.float32)
        lo = hi
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes.

    The sample is chosen on (doc_id, lang) alone: the ids of each language that hash lowest, first within ``SALTS`` parts, then
    over ``FAN`` parts at a time, so that no task ranks more than ``FAN`` samples of a language. Only the chosen ids, at most ``SAMPLE``,
    are broadcast.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    ranked = usable.select("*", F.xxhash64(F.lit(SEED), "doc_id").alias("h"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("part"))
    parts = SALTS
    while parts:
        by = Window.partitionBy("lang", "part").orderBy("h", "doc_id")
        ranked = ranked.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= per_language)
        ranked, parts = ranked.withColumn("part", F.floor(F.col("part") / FAN)), parts // FAN
    ids = ranked.orderBy("h", "doc_id", "lang").limit(SAMPLE).select("doc_id", "lang").distinct()
    chosen = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                b = big.slice(lo, 512)
                vectors = unit(bundle([letters_of(t) for t in b.column("text").to_pylist()])).astype(np.float64)
                for lang, v in zip(b.column("lang").to_pylist(), vectors, strict=True):
                    sums[lang] = sums.get(lang, 0) + v
            if len(sums) > 1000:
                yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": pa.array(list(sums.values()), pa.list_(pa.float64()))})
                sums = {}
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": pa.array(list(sums.values()), pa.list_(pa.float64()))})

    parts = chosen.mapInArrow(trimmed(bundles), "lang string, v array<double>").select("lang", F.posexplode("v").alias("d", "x"))
    summed = parts.groupBy("lang", "d").agg(F.round(F.sum("x"), 6).alias("x"))
    # one array a language, as Arrow
    rows = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda r: r["x"]).alias("v")).orderBy("lang").toArrow()
    langs = rows.column("lang").to_pylist()
    prototypes = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
    seen = np.abs(prototypes).sum(1) > 0  # a language may have no letters in any document
    return [x for x, s in zip(langs, seen, strict=True) if s], unit(prototypes[seen])


def predict(texts: list[str | None], langs: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language and cosine of each text."""
    letters = [letters_of(t) for t in texts]
    if not langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    cos = unit(bundle(letters).astype(np.float64)) @ prototypes.T
    best = cos.argmax(1)
    some = np.array([len(x) > 0 for x in letters], bool)
    return [langs[i] if s else "und" for i, s in zip(best, some, strict=True)], np.where(some, np.clip(cos.max(1), 0, 1), 0.0)


def identified(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, per_language))  # languages by dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                b = big.slice(lo, 512)
                langs, scores = predict(b.column("text").to_pylist(), *shared.value)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    x = docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, lang_pred string, score double")
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
