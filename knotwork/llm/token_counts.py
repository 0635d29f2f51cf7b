"""Operator 10: edit-aware token counts.

Each document has a segment tree over its pre-tokens: leaves hold runs of pre-tokens with their lengths and token
counts, inner nodes the sums. An edit (position, characters to delete, text to insert) finds its place by the sums of
lengths, re-encodes only the pre-tokens it touches and their boundary context, and updates the sums on one path.

Boundary context. The splitting rule scans from left to right and looks at most one character past a match, so a match
that ends two characters or more before an edit stays, and from any old border behind the edit that is a border again,
everything stays. Re-encoding starts one pre-token before the first that may change and ends at the first such border.

Counts of pre-tokens are kept in a bounded store of each worker; a pre-token is encoded by the public byte-level BPE.

Defined results. Null text: as empty, 0 tokens. Positions beyond the text's end are moved to it, deletions end with the
text, negative numbers count as 0, null insertions as empty; edits without a doc_id or without a document are left out.
Edits of one document apply in order of ``seq``. Repeated rows are counted each. Extra columns are ignored.
Texts of any length are counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.runtime import KEPT, ship_package, trimmed

#: Pre-tokens of a new leaf; a leaf may grow to LEAF_MOST before the tree is built anew.
LEAF, LEAF_MOST, FANOUT = 64, 1024, 16
#: Bytes of pre-tokens whose counts are kept, what an entry costs beside its text, characters from which one is not kept.
KEEP, ENTRY, LONG = 48_000_000, 150, 1000

_CODECS: dict[str, Codec] = {}
KEPT[__name__] = _CODECS.clear


class Codec:
    """Splitting rule and token counts of a byte-level BPE rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bpe = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.known: dict[str, int] = {}
        self.held = 0

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        new = set(pieces).difference(known)
        if new:
            if self.held > KEEP:
                known.clear()
                self.held, new = 0, set(pieces)
            for p in new:
                known[p] = len(self.bpe._encode_single_piece(p))
                self.held += ENTRY + len(p)
        out = [known[p] for p in pieces]
        for p in new:
            if len(p) > LONG:
                del known[p]
                self.held -= ENTRY + len(p)
        return out


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path, pattern)
    return _CODECS[path]


class CountTree:
    """A document's pre-token segment tree."""

    def __init__(self, text: str, codec: Codec):
        self.text, self.codec, self.reencoded = text, codec, 0
        pieces = codec.split(text)
        self._build([len(p) for p in pieces], codec.counts(pieces))

    def _build(self, sizes: list[int], counts: list[int]) -> None:
        n = max(1, -(-len(sizes) // LEAF))
        self.sizes = [sizes[i * LEAF : (i + 1) * LEAF] for i in range(n)]
        self.counts = [counts[i * LEAF : (i + 1) * LEAF] for i in range(n)]
        #: levels[0] has a row (characters, tokens) a leaf, each level above the sums of FANOUT rows.
        self.levels = [np.array([[sum(s), sum(c)] for s, c in zip(self.sizes, self.counts, strict=True)], np.int64)]
        while len(self.levels[-1]) > 1:
            self.levels.append(np.add.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), FANOUT), axis=0))

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and its offset: from the root down by the sums of lengths."""
        node, start = 0, 0
        for level in self.levels[-2::-1]:
            node *= FANOUT
            end = min(node + FANOUT, len(level)) - 1
            while node < end and start + level[node, 0] <= position:
                start += int(level[node, 0])
                node += 1
        return node, start

    def _update(self, leaf: int) -> None:
        """New sums of a leaf and of the nodes above it."""
        self.levels[0][leaf] = sum(self.sizes[leaf]), sum(self.counts[leaf])
        for below, level in zip(self.levels, self.levels[1:], strict=False):
            leaf //= FANOUT
            level[leaf] = below[leaf * FANOUT : (leaf + 1) * FANOUT].sum(0)

    def edit(self, position: int, delete: int, insert: str) -> None:
        position = min(max(0, position), len(self.text))
        end = min(position + max(0, delete), len(self.text))
        grown = len(insert) - (end - position)
        new = self.text[:position] + insert + self.text[end:]
        # the first pre-token that may change, and one more
        leaf, start = self._leaf_at(max(0, position - 2))
        at, i = start, 0
        while i < len(self.sizes[leaf]) - 1 and at + self.sizes[leaf][i] <= position - 2:
            at += self.sizes[leaf][i]
            i += 1
        if i:
            i -= 1
            at -= self.sizes[leaf][i]
        elif leaf:
            leaf -= 1
            while leaf and not self.sizes[leaf]:
                leaf -= 1
            i = max(0, len(self.sizes[leaf]) - 1)
            at -= sum(self.sizes[leaf][i:])
        first, first_i, begin = leaf, i, at
        # pre-tokens from there, until a border meets an old one behind the edit
        pieces, here = [], begin
        old, last, last_i = begin, leaf, i
        stop = False
        for m in self.codec.pattern.finditer(new, begin):
            while last < len(self.sizes) and (old < end or old + grown < here):
                if last_i < len(self.sizes[last]):
                    old += self.sizes[last][last_i]
                    last_i += 1
                else:
                    last, last_i = last + 1, 0
            if old >= end and old + grown == here and here >= position + len(insert):
                stop = True
                break
            pieces.append(m[0])
            here = m.end()
        if not stop:
            last, last_i = len(self.sizes) - 1, len(self.sizes[-1])
        counts = self.codec.counts(pieces)
        self.reencoded += len(pieces)
        self.text = new
        tail = (self.sizes[last][last_i:], self.counts[last][last_i:]) if last < len(self.sizes) else ([], [])
        self.sizes[first] = self.sizes[first][:first_i] + [len(p) for p in pieces] + tail[0]
        self.counts[first] = self.counts[first][:first_i] + counts + tail[1]
        for k in range(first + 1, min(last + 1, len(self.sizes))):
            self.sizes[k], self.counts[k] = [], []
            self._update(k)
        self._update(first)
        if len(self.sizes[first]) > LEAF_MOST:
            self._build([x for s in self.sizes for x in s], [x for c in self.counts for x in c])


def edit_script(docs: DataFrame, n_edits: int = 4) -> DataFrame:
    """(doc_id, text, edits): ``n_edits`` edits a document, drawn from its id: short spans replaced by its own words."""
    length = F.length(F.coalesce("text", F.lit("")))
    h = lambda k, what: F.xxhash64(F.lit(what), F.lit(k), "doc_id")

    def one(k: int):
        return F.struct(
            F.lit(k).alias("seq"),
            F.pmod(h(k, "position"), length.cast("long") + 1).alias("position"),
            F.pmod(h(k, "delete"), F.lit(24)).alias("delete"),
            F.coalesce(F.substring("text", 1, 3 + 5 * k), F.lit("")).alias("insert"),
        )

    return docs.select("doc_id", "text", F.array(*map(one, range(n_edits))).alias("edits"))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, text, edits) of a table of edits (doc_id, seq, position, delete, insert)."""
    e = edits.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "seq", F.coalesce("position", F.lit(0)).cast("long").alias("position"), F.coalesce("delete", F.lit(0)).cast("long").alias("delete"), F.coalesce("insert", F.lit("")).alias("insert")
    ))).alias("edits"))
    return docs.select("doc_id", "text").join(e, "doc_id", "left")


def counted(edited: DataFrame, ranks: str, pattern: str, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_reencoded (pre-tokens encoded again) of (doc_id, text, edits)."""
    ship_package(edited.sparkSession)
    schema = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_reencoded long" + ", text_edited string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                rows = []
                for doc_id, text, edits in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("edits").to_pylist(), strict=True):
                    tree = CountTree(text.as_py() or "", c)
                    before = tree.tokens
                    for e in edits or []:
                        tree.edit(e["position"], e["delete"], e["insert"])
                    rows.append((doc_id, before, len(edits or []), tree.tokens, tree.reencoded, *[tree.text] * keep_text))
                types = [pa.int64()] * 5 + [pa.string()] * keep_text
                names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded", *["text_edited"] * keep_text]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return edited.select("doc_id", "text", "edits").mapInArrow(trimmed(run), schema)
