"""Operator 6: n-gram Jaccard join by a size-aware heavy-light scheme.

A document is the set of its distinct 5-word shingles (as 64-bit hashes). Two documents link when their sets have
Jaccard similarity of 0.8 or more; the operator returns the components of these links.

1. One pass over the texts gives each document's set size, a digest of its set, and a sketch that counts shingles by hash
   bucket over all documents; its bounded size follows the length of all texts. Documents with equal sets form one class.
2. Exact join (after Deng, Tao and Li 2018). In every set shingles are ordered by the sketch's counts, rarest
   first, then by hash. If sets A and B link, the first |A| - ceil(0.8 |A|) + k shingles of A and those of B
   share k shingles. Large sets scan inverted lists: all sets post the shingles for k = 1, and pairs with a large set are
   read off the lists. Small sets enumerate all 2-subsets of their shingles for k = 2; equal subsets give the pairs of
   small sets. The boundary between small and large is the one of least estimated cost, from the histogram of set sizes
   and the sketch. Sizes and places in the order rule out most pairs in a list before they are compared. Long lists are
   scanned several times: first rows near each other in one order for all lists, then in another, whose links unite most of a
   list; then all pairs still apart, in pairs of blocks of the list's exact length.
3. Candidates that share too few of their leading shingles go; every other one is compared exactly on whole sets, and
   components are united over all links.

Skew. Equal sets cost one row for each task after partial aggregation. Lists that the sketch shows to be long are dealt
to blocks: pairs of blocks are separate groups. No list is capped, no pair of a list is dropped unless its bound rules it out.
Candidate pairs never leave a task twice for one list, and never for pairs already united.

Defined results. Null text, or text without words: n_shingles 0 and a component of its own. Fewer than five words: the whole
sequence is the one shingle. Null doc_id: never a link's end; its component is null unless equal to another document.
Rows that share a doc_id count as one document for reaching others. Texts of any length are read whole. Extra columns
are ignored. Empty table: empty result. Hashes of 64 bits stand for shingles; two shingles of one comparison collide
with probability below 1e-10 even in the longest texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.components import members, stars
from knotwork.runtime import cut, release, ship_package, trimmed

WORDS = 5
#: Buckets of the sketch, at least and at most; its parts; sketches that one task sums; shingles counted at once.
SKETCH_BITS, PARTS, FAN, COUNTED = (22, 24), 16, 64, 1 << 19
#: Rows of an inverted list that meet in one group; characters handled at once; bits of the filter of candidate ids.
LIST, CHUNK, FILTER_BITS = 2048, 1 << 18, 24
#: Bytes from which a word is hashed by a digest; ids of a clump of candidates that meet at once.
LONG, BLOCK = CHUNK // 4, 32
#: Rows from which a list is first searched in part, and how far apart its rows are paired in the scans before the last.
MANY, NEAR = 16, (6, 16)
#: Set sizes told apart when the boundary is chosen; larger sets count as the last.
SIZES = 64

_R = 0x9E3779B97F4A7C15
_PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, and a random number for each byte."""
    up, down = np.full(CHUNK, _R, np.uint64), np.full(CHUNK, pow(_R, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of UTF-8 bytes that end in white space, A-Z as a-z.

    Words are hashed by polynomials over running sums, in stretches of bounded length that end between words; words of
    ``LONG`` bytes or more have a digest instead.
    """
    up, down, values = _powers()
    space = np.flatnonzero(_SPACE[data])
    hashes, firsts, lo = [], [], 0
    while lo < len(data):
        k = int(np.searchsorted(space, lo + CHUNK - 1, "right")) - 1
        hi = int(space[k]) + 1 if k >= 0 and space[k] >= lo else int(space[np.searchsorted(space, lo)]) + 1
        part = _FOLD[data[lo:hi]]
        edge = np.flatnonzero(np.diff(~_SPACE[part], prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if hi - lo <= CHUNK:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[part] * up[: len(part)])])
            h = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        else:  # one word
            h = np.zeros(len(starts), np.uint64)
        for i in np.flatnonzero(ends - starts >= LONG):
            h[i] = int.from_bytes(hashlib.blake2b(part[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        hashes.append(h), firsts.append(starts + lo)
        lo = hi
    return np.concatenate(hashes), np.concatenate(firsts)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty without words."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    words, starts = word_hashes(np.frombuffer(b" ".join(raw) + b" ", np.uint8))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))
    n = max(0, len(words) - WORDS + 1)
    grams = sum((words[i : i + n] * _PLACE[i] for i in range(WORDS)), np.zeros(n, np.uint64))
    grams = mixed(grams)
    out = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        if hi - lo >= WORDS:
            out.append(np.unique(grams[lo : hi - WORDS + 1]))
        elif hi > lo:
            out.append(mixed((words[lo:hi] * _PLACE[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo)))
        else:
            out.append(grams[:0])
    return out


def in_chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch of bounded size, with the sets of their texts."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy())
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHUNK, "right")))
        part = batch.slice(lo, hi - lo)
        yield part, shingle_sets(part.column(column).to_pylist())
        lo = hi


def needed(a, b):
    """Shared shingles that sets of sizes a and b need: 100 * i >= 80 * (a + b - i)."""
    return -(-4 * (a + b) // 9)


def prefix(n, k: int):
    """Leading shingles of a set of size n of which k are shared with every set that links to it."""
    return np.minimum(n, n + (-4 * n // 5) + k)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Elements in both of two arrays, each without repetitions."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    n = shared(a, b)
    return n > 0 and 100 * n >= 80 * (len(a) + len(b) - n)


SIGNATURES = "doc_id long, n long, d0 long, d1 long, task int, part int, counts binary"


def sketch_bits(docs: DataFrame) -> int:
    """Buckets for about 64 shingles each, inside the bounds of the sketch."""
    characters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(SKETCH_BITS[0], min(SKETCH_BITS[1], (characters // 400).bit_length()))


def signatures(docs: DataFrame, bits: int = SKETCH_BITS[0]) -> DataFrame:
    """Rows of documents (size, digest) and, with ``part`` set, of each task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << bits, np.int32), []

        def add() -> None:
            # by the buckets met, not by an array of all of them: workers have little memory
            at, n = np.unique(np.concatenate(seen), return_counts=True)
            counts[at] += n.astype(np.int32)
            seen.clear()

        for batch in batches:
            for part, sets in in_chunks(batch):
                seen.append(_bucket(np.concatenate(sets) if sets else np.zeros(0, np.uint64), bits).astype(np.int32))
                if sum(map(len, seen)) > COUNTED:
                    add()
                digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                none = pa.nulls(len(sets), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), none, none, pa.nulls(len(sets), pa.binary())],
                    names=["doc_id", "n", "d0", "d1", "task", "part", "counts"],
                )
        if seen:
            add()
        if counts.any():
            task, pieces = TaskContext.get().partitionId(), np.split(counts, PARTS)
            none = pa.nulls(PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array([task] * PARTS, pa.int32()), pa.array(range(PARTS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in pieces], pa.binary())],
                names=["doc_id", "n", "d0", "d1", "task", "part", "counts"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), SIGNATURES)


def sketch_of(table: DataFrame, bits: int = SKETCH_BITS[0]) -> np.ndarray:
    """The sum of all tasks' sketches, of fixed size; by a tree, so that no task sums more than ``FAN`` of them."""

    def total(t: pa.Table) -> pa.Table:
        s = np.zeros((1 << bits) // PARTS, np.int64)
        for c, wide in zip(t.column("counts"), t.column("wide").to_pylist(), strict=True):
            s += np.frombuffer(zlib.decompress(c.as_py()), np.int64 if wide else np.int32)
        return pa.table({"task": pa.array([t.column("task")[0].as_py() // FAN], pa.int32()), "part": t.column("part").slice(0, 1), "counts": pa.array([zlib.compress(s.tobytes(), 1)], pa.binary()), "wide": [True]})

    sums = table.where("part IS NOT NULL").select("task", "part", "counts", F.lit(False).alias("wide"))
    tasks = (sums.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        sums, tasks = sums.groupBy("part", F.floor(F.col("task") / FAN)).applyInArrow(total, "task int, part int, counts binary, wide boolean"), -(-tasks // FAN)
        if tasks == 1:
            break
    rows = {r.part: np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64) for r in sums.select("part", "counts").collect()}
    width = (1 << bits) // PARTS
    return np.concatenate([rows.get(p, np.zeros(width, np.int64)) for p in range(PARTS)])


def _filter(ids: DataFrame) -> np.ndarray:
    """A bit filter of fixed size that holds all ids; it only saves shuffling, joins decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            bits[_slots(b.column("id").to_numpy())] = True
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "bits": pa.array([zlib.compress(p.tobytes(), 1) for p in np.split(np.packbits(bits), PARTS)], pa.binary())})

    def union(t: pa.Table) -> pa.Table:
        u = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in t.column("bits")])
        return pa.table({"part": t.column("part").slice(0, 1), "bits": pa.array([zlib.compress(u.tobytes(), 1)], pa.binary())})

    rows = {r.part: bytes(r.bits) for r in ids.mapInArrow(trimmed(run), "part int, bits binary").groupBy("part").applyInArrow(union, "part int, bits binary").collect()}
    empty = zlib.compress(bytes((1 << FILTER_BITS) // 8 // PARTS), 1)
    return np.frombuffer(b"".join(zlib.decompress(rows.get(p, empty)) for p in range(PARTS)), np.uint8)


def _holds(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def met(pairs: DataFrame, values: DataFrame, good: Callable[[np.ndarray, int, np.ndarray, int], bool]) -> DataFrame:
    """The pairs (a, b) for which ``good`` holds of any of their ``values`` (id, n, shingles).

    Candidates come in clumps. Ids with the same smallest neighbour are dealt to blocks of about ``BLOCK``, and a pair belongs
    to the pair of its ids' blocks, so a value moves once for each pair of blocks and not once for each pair.
    """
    both = pairs.select(F.col("a").alias("id"), "b").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("b")))
    label = both.groupBy("id").agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label"))
    blocks = label.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    home = cut(label.join(blocks, "label").select("id", F.xxhash64("label", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("home")))
    side = lambda end: home.select(F.col("id").alias(end), F.col("home").alias(f"home_{end}"))
    keyed = pairs.join(side("a"), "a").join(side("b"), "b")
    keyed = cut(keyed.select(F.xxhash64(F.least("home_a", "home_b"), F.greatest("home_a", "home_b")).alias("key"), "a", "b"))
    none = lambda kind: F.lit(None).cast(kind)
    guests = keyed.select("key", F.col("a").alias("id")).unionByName(keyed.select("key", F.col("b").alias("id"))).distinct().join(values, "id")
    rows = guests.select("key", none("long").alias("a"), none("long").alias("b"), "id", "n", "shingles").unionByName(keyed.select("key", "a", "b", none("long").alias("id"), none("long").alias("n"), none("binary").alias("shingles")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, here = None, {}
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("key", "a", "b", "id", "n")]
            for k, a, b, i, n, s in zip(*columns, batch.column("shingles"), strict=True):
                if k != key:
                    key, here = k, {}
                if a is None:
                    here.setdefault(i, []).append((np.frombuffer(s.as_buffer(), np.uint64), n))
                elif any(good(*x, *y) for x in here.get(a, ()) for y in here.get(b, ())):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", F.col("a").asc_nulls_first()).mapInArrow(trimmed(compare), "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose documents link, by their whole sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return met(pairs, sets_of(docs, ids), lambda x, _, y, __: linked(x, y))


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, shingles) of the documents with these ids, and of a few others that the filter lets through."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(ids))  # of fixed size

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column("doc_id")))
            at = _slots(b.column("doc_id").to_numpy())
            for part, found in in_chunks(b.filter(pa.array(_holds(bits.value, at)))):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "n", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(sets), "id long, n long, shingles binary")


def boundary(histogram: dict[int, int], sketch: np.ndarray) -> int:
    """The largest size of a small set, at the least estimated cost.

    A small set costs a row for each 2-subset. A large set costs a row for each leading shingle and the part of its list
    that it meets, estimated from the counts above the sketch's even share. Sets within reach of large ones also post lists.
    """
    total = max(1, int(sketch.sum()))
    even = total / len(sketch)
    excess = np.maximum(0, sketch - even - 4 * np.sqrt(even))
    met = float((excess * sketch).sum() / total)
    sizes = np.arange(1, SIZES + 1)
    n = np.array([histogram.get(int(s), 0) for s in sizes], float)
    subsets = prefix(sizes, 2) * (prefix(sizes, 2) - 1) / 2
    lists = prefix(sizes, 1)

    def cost(x: int) -> float:
        small, posts = sizes <= x, sizes >= 4 * (x + 1) / 5
        return float((n * subsets)[small].sum() + (n * lists)[posts].sum() + (n * lists * min(met, LIST))[~small].sum())

    return min(range(SIZES), key=cost)


def leads(docs: DataFrame, classes: DataFrame, sent: Broadcast) -> DataFrame:
    """(rep, n, lead): of each class the leading shingles for k = 2, in order; ``sent`` is the sketch."""

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        even = counts.mean()
        floor = even + 6 * np.sqrt(even) + 4
        for b in batches:
            for part, sets in in_chunks(b.filter(pc.is_valid(b.column("doc_id")))):
                lead = []
                for s in sets:
                    c = np.maximum(_counts(s, counts), floor)
                    # s is sorted, so a stable sort by count leaves ties in order of hash
                    lead.append(s[np.argsort(c, kind="stable")[: int(prefix(len(s), 2))]].tobytes())
                digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests[:, 0]), pa.array([len(s) for s in sets], pa.int64()), pa.array(lead, pa.binary())], names=["rep", "d0", "n", "lead"])

    lead = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(ordered), "rep long, d0 long, n long, lead binary")
    return lead.join(classes.select("rep", "d0"), ["rep", "d0"]).select("rep", "n", "lead")


def _sent(spark: SparkSession, sketch: np.ndarray) -> Broadcast:
    """The sketch for the executors; its size is fixed."""
    return spark.sparkContext.broadcast(sketch.astype(np.int32) if sketch.max(initial=0) < 2**31 else sketch)


def _bucket(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def _counts(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """What the sketch, of 2 ^ bits buckets, has of these shingles."""
    return sketch[_bucket(s, len(sketch).bit_length() - 1)]


def postings(lead: DataFrame, sent: Broadcast, small: int, only: np.ndarray | None = None) -> DataFrame:
    """(key, spot, before, earlier, rep): a row for each inverted list or 2-subset that a class takes part in; those in the
    bit filter ``only``, if given. ``spot`` packs the set's size, the place of the (first) shingle in the class's order and
    whether it is a list; ``before`` and ``earlier`` are the two shingles before it in that order, in lists, or 0."""
    chosen = lead.sparkSession.sparkContext.broadcast(only)  # of fixed size

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        even = counts.mean()
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                b = big.slice(lo, 512)
                columns = [[] for _ in range(5)]
                for rep, n, lead in zip(b.column("rep").to_pylist(), b.column("n").to_pylist(), b.column("lead"), strict=True):
                    lead = np.frombuffer(lead.as_buffer(), np.uint64)
                    if n <= small:
                        i, j = np.triu_indices(len(lead), 1)
                        add(columns, mixed(np.minimum(lead[i], lead[j]) ^ mixed(np.maximum(lead[i], lead[j]))), _counts(lead[i], counts), i, n, rep, even, False)
                    if 5 * n >= 4 * (small + 1):
                        one = lead[: int(prefix(n, 1))]
                        add(columns, one, _counts(one, counts), np.arange(len(one)), n, rep, even, True)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["key", "spot", "before", "earlier", "rep"])

    def add(columns: list[list], keys: np.ndarray, counts: np.ndarray, place: np.ndarray, n: int, rep: int, even: float, single: bool) -> None:
        """Rows of one class; in long lists a row goes to all pairs of blocks that hold its own."""
        blocks = 1 + (np.maximum(0, counts - even) // LIST).astype(np.int64)
        plain, none = keys, np.zeros(min(2, len(keys)), np.uint64)
        before, earlier = (np.concatenate([none[:k], plain[: len(plain) - k]]) if single else np.zeros(len(plain), np.uint64) for k in (1, 2))
        keys = keys ^ np.uint64(single)
        if blocks.max(initial=1) > 1:
            own = (mixed(np.array([rep], np.int64).view(np.uint64))[0] % blocks.astype(np.uint64)).astype(np.int64)
            at = np.repeat(np.arange(len(keys)), blocks)
            other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            pair = np.minimum(own[at], other) * blocks[at] + np.maximum(own[at], other)
            keys, place, before, earlier = mixed(keys[at] + pair.astype(np.uint64)), place[at], before[at], earlier[at]
        if chosen.value is not None:
            at = _slots(keys.view(np.int64))
            keep = _holds(chosen.value, at)
            keys, place, before, earlier = keys[keep], place[keep], before[keep], earlier[keep]
        spot = (np.int64(n) << 32) + (place.astype(np.int64) << 1) + int(single)
        for c, v in zip(columns, (keys.view(np.int64), spot, before.view(np.int64), earlier.view(np.int64), np.full(len(keys), rep, np.int64)), strict=True):
            c.append(v)

    return lead.mapInArrow(trimmed(posted), "key long, spot long, before long, earlier long, rep long")


def promising(pairs: DataFrame, lead: DataFrame) -> DataFrame:
    """The pairs whose leading shingles alone do not rule them out.

    If sets of sizes a and b share c = needed(a, b) shingles, the first p of A and the first q of B share at least
    min(p - a, q - b) + c of them. The leads are a fifth of the sets, so most false candidates go before sets move.
    """
    return met(pairs, lead.select(F.col("rep").alias("id"), "n", F.col("lead").alias("shingles")), lambda x, n, y, m: shared(x, y) >= min(len(x) - n, len(y) - m) + needed(n, m))


def candidate_pairs(posts: DataFrame, small: int, near: int | None) -> DataFrame:
    """(a, b, open, size): pairs of a list that sizes and places do not rule out, of different components (``root``, where
    known); small sets only by subsets. With ``near``, lists of more than ``MANY`` rows, in an order of chance, give the pairs of rows up to ``near``
    apart alone, and their key as ``open`` with the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if held is not None else b
            key = t.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1], "left"))  # the last list may go on
            if last:
                yield from lists(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield from lists(held)

    def lists(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, spot, before, earlier, rep = (t.column(c).to_numpy() for c in ("key", "spot", "before", "earlier", "rep"))
        root = t.column("root").to_numpy() if "root" in t.schema.names else rep
        n, place, single = spot >> 32, (spot & 0xFFFFFFFF) >> 1, spot & 1 == 1
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        # lists whose rows are all of one component have nothing to add
        several = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
        end = np.repeat(np.where(several, start + size, start), size)
        partly = several & (size > max(MANY, near or 0)) & (near is not None)
        reach = np.repeat(np.where(partly, near or 0, size), size)
        if partly.any():
            keys = key[start[partly]]
            none = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(keys), pa.array(size[partly].astype(np.int64))], names=["a", "b", "open", "size"])
        i = np.flatnonzero(np.arange(len(key)) + 1 < end)
        d, found, held = 1, [], 0
        while len(i):
            j = i + d
            a, b = n[i], n[j]
            good = (root[i] != root[j]) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (np.minimum(a - place[i], b - place[j]) >= needed(a, b)) & (~single[i] | (np.maximum(a, b) > small))
            # a pair that shares one of the two shingles before is a pair of that shingle's list, at better places
            for x in (before, earlier):
                for y in (before, earlier):
                    good &= (x[i] != y[j]) | (x[i] == 0)
            if good.any():
                found.append((rep[i[good]], rep[j[good]]))
                held += len(found[-1][0])
            d += 1
            i = i[(i + d < end[i]) & (d <= reach[i])]
            if found and (held > 500_000 or not len(i)):
                yield pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))
                found, held = [], 0

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((hi, lo))
        lo, hi = lo[order], hi[order]
        new = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        none = pa.nulls(int(new.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(lo[new]), pa.array(hi[new]), none, none], names=["a", "b", "open", "size"])

    x = posts.repartition("key").sortWithinPartitions("key", F.xxhash64("rep", F.lit(near or 0)))
    return x.mapInArrow(trimmed(run), "a long, b long, open long, size long").where("a IS NULL OR a <> b").distinct()


def joined(docs: DataFrame, links_by_phase: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; ``links_by_phase``, if given, gets the links that each scan found."""
    spark = docs.sparkSession
    ship_package(spark)
    bits = sketch_bits(docs)
    table = cut(signatures(docs, bits))
    sketch = sketch_of(table, bits)
    rows = table.where("part IS NULL").select("doc_id", "n", "d0", "d1")
    classes = cut(rows.where("n > 0").groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")).where("rep IS NOT NULL"))
    sizes = classes.groupBy(F.least("n", F.lit(SIZES)).alias("n")).count().collect()  # at most SIZES rows
    small = boundary({int(r.n): r["count"] for r in sizes}, sketch)
    sent = _sent(spark, sketch)
    del sketch
    release(spark)
    lead = cut(leads(docs, classes, sent))
    united = open_lists = None
    for near in (*NEAR, None):
        if united is None:
            posts = postings(lead, sent, small)
        elif open_lists.isEmpty():
            break
        else:
            posts = _apart(postings(lead, sent, small, _filter(open_lists.select("id"))), united, None if near else open_lists)
        found = cut(candidate_pairs(posts, small, near))
        del posts
        release(spark)
        new = cut(verified(docs, cut(promising(found.where("a IS NOT NULL").select("a", "b"), lead))))
        if links_by_phase is not None:
            links_by_phase[f"rows up to {near} apart" if near else "all pairs still apart"] = new.count()
        release(spark)
        united = stars(new if united is None else new.unionByName(united.toDF("a", "b")))
        open_lists = cut(found.where("open IS NOT NULL").groupBy(F.col("open").alias("id")).agg(F.max("size").alias("size")))
        del found, new
        release(spark)
    final = members(united)
    member = rows.join(classes.select("d0", "d1", "rep"), ["d0", "d1"], "left").select("doc_id", "n", "rep")
    # a row of no class (an empty set) keeps its own id
    out = member.join(final.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def _apart(posts: DataFrame, united: DataFrame, open_lists: DataFrame | None) -> DataFrame:
    """Postings of long lists with the component of each class, now that many of their rows are united.

    With ``open_lists``, lists longer than the sketch told are dealt to blocks by their length, for the comparison of all pairs:
    a row goes to all pairs of blocks that hold its own.
    """
    now = posts.join(united.toDF("rep", "smallest"), "rep", "left").withColumn("root", F.coalesce("smallest", "rep"))
    if open_lists is None:
        return now.select(*posts.columns, "root")
    long = open_lists.where(F.col("size") > LIST).select(F.col("id").alias("key"), F.ceil(F.col("size") / LIST).alias("blocks"))
    now = now.join(long, "key", "left").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    now = now.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    key = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return now.withColumn("key", key).select(*posts.columns, "root")


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; all columns unchanged.

    Rows are documents of their own even where they share a doc_id: only rows equal in doc_id and text are copies, of which the
    one whose JSON comes first stays. Of unlike texts under one id none goes unless it links to another document. Rows
    with a null doc_id stay.
    """
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    if ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        keep = joined(docs).where("doc_id = component_id").select("doc_id")
        return docs.join(keep, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
    # a row's own id is a hash of its id and text; another hash tells rows apart that should share it by chance
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.xxhash64("doc_id", "text").alias("own"), F.xxhash64(F.lit(1), "doc_id", "text").alias("mark"), "doc_id", "text", whole.alias("row"))
    member = cut(joined(rows.select(F.col("own").alias("doc_id"), "text")).select(F.col("doc_id").alias("own"), "component_id").distinct())
    first = rows.select("own", "doc_id").distinct().join(member, "own").groupBy("component_id").agg(F.min(F.struct("doc_id", "own")).alias("first"))
    kept = rows.join(first.select("first.own"), "own", "left_semi").groupBy("own", "mark").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.select("row.*").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
