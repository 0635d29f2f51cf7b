"""Operator 3: BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch form a trie; sorted, they list it in depth-first order. For every prefix on the current
path the traversal keeps one state: the last token of the prefix's BPE encoding. A new state is found from the tokens
that end at it: exactly one of them forms a compatible pair with the last token of the prefix before it, and a sequence
of tokens is the BPE encoding of its text when all neighbours are compatible. So shared prefixes are encoded once, and
a word's tokens are read backwards from its states.

A pair is compatible when no merge across its border would happen before the merges that hide the border on either
side. The merge trees of the two tokens tell which symbols stand at the border, and when.

Words come from the tokenizer file itself: its normaliser and splitting rule. Plain words of ASCII and Latin-1 take an
equal fast way; anything else goes through the file's own normaliser and splitter. White space never joins two words,
so texts are cut at white space first; pieces and words seen lately stay in bounded stores of each worker.

Defined results. Null text: as empty, no tokens; the hashes are those of no bytes. The strings of the special tokens in
a text give their ids, as in the library. Repeated rows are encoded each; extra columns are ignored; texts of any
length are read whole, an unbroken word in time linear in its length; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knotwork.runtime import KEPT, ship_package, trimmed

END = "</w>"
NEVER = 1 << 60
#: Pairs of tokens whose compatibility is kept.
PAIRS = 300_000
#: Bytes of pieces and of words kept in each of two generations, and what an entry costs beside its text; characters from which
#: a piece or word is not kept; pieces of one trie, documents and characters handled at once.
KEEP_PIECES, KEEP_WORDS, ENTRY, LONG, TRIE_PIECES, AT_ONCE_DOCS, AT_ONCE_CHARS = 24_000_000, 60_000_000, 180, 1000, 20_000, 256, 1_000_000

#: Pieces of visible ASCII and the letters of Latin-1: composed, and changed by lower case alone.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The contractions, letter runs, single digits and other runs of the splitting rule, for such pieces in lower case.
_PLAIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: White space as Unicode defines it; str.split() also splits at the four information separators.
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Store:
    """A store bounded in bytes, in two generations: when the young one is full it becomes the old one."""

    def __init__(self, most: int):
        self.most, self.young, self.old, self.held = most, {}, {}, 0

    def renewed(self, keys: set[str]) -> dict[str, bytes]:
        """The young generation, with what is known of ``keys`` in it."""
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        if self.old:
            for k in (keys - self.young.keys()) & self.old.keys():
                self.put(k, self.old[k])
        return self.young

    def put(self, key: str, value: bytes) -> None:
        self.young[key] = value
        self.held += ENTRY + len(key) + len(value)

    def drop(self, keys: Iterable[str]) -> None:
        """Forget long entries, which are needed once."""
        for k in keys:
            if len(k) > LONG and (value := self.young.pop(k, None)) is not None:
                self.held -= ENTRY + len(k) + len(value)


class TrieBpe:
    """Encoder and decoder for a tokenizer file with word-end BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("continuing_subword_prefix") or model.get("unk_token"):
            raise ValueError("a BPE model with word ends and no unknown token is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.any_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        #: lengths of the tokens, longest first, by their last three characters (and word end)
        self.sizes: dict[str, list[int]] = {}
        for t in self.vocab:
            plain, end = (t[: -len(END)], END) if t.endswith(END) else (t, "")
            if len(plain) > 2 and len(plain) not in self.sizes.setdefault(plain[-3:] + end, []):
                self.sizes[plain[-3:] + end].append(len(plain))
        for v in self.sizes.values():
            v.sort(reverse=True)
        library = Tokenizer.from_file(path)
        self.normaliser, self.splitter = library.normalizer, library.pre_tokenizer
        self.spines: dict[str, tuple[list, list] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.store, self.words = Store(KEEP_PIECES), Store(KEEP_WORDS)
        #: the byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes follow from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.bytes = {b: 256 + i for i, b in enumerate(hidden)}
        self.back = {c: b for b, c in self.bytes.items()}

    # merge trees

    def symbols(self, token: str) -> list[str]:
        plain = token.removesuffix(END)
        return [*plain[:-1], plain[-1] + END] if plain != token and plain else list(token)

    def tree(self, token: str) -> tuple[list, list] | None:
        """The token's borders over time: (symbol, rank that makes it, rank that hides it), left and right; None if
        merging the token's symbols does not give the token."""
        if token not in self.spines:
            parts = [(s, -1, [(s, -1)], [(s, -1)]) for s in self.symbols(token)]
            while len(parts) > 1:
                rank, i = min((self.ranks.get((a[0], b[0]), NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == NEVER:
                    break
                a, b = parts[i], parts[i + 1]
                made = a[0] + b[0]
                parts[i : i + 2] = [(made, rank, [*a[2], (made, rank)], [*b[3], (made, rank)])]
            ends = lambda spine: [(s, made, spine[k + 1][1] if k + 1 < len(spine) else NEVER) for k, (s, made) in enumerate(spine)]
            self.spines[token] = (ends(parts[0][2]), ends(parts[0][3])) if len(parts) == 1 and parts[0][0] == token else None
        return self.spines[token]

    def compatible(self, left: str, right: str) -> bool:
        """Whether BPE of the two tokens' joined symbols gives these two tokens."""
        known = self.pairs.get((left, right))
        if known is None:
            a, b = self.tree(left)[1], self.tree(right)[0]
            known, i, j = True, 0, 0
            while i < len(a) and j < len(b):
                (x, _, x_gone), (y, _, y_gone) = a[i], b[j]
                rank = self.ranks.get((x, y), NEVER)
                if rank < x_gone and rank <= y_gone and rank < NEVER:
                    known = False
                    break
                # the symbol that is merged away first makes room for the next on its side; of equal ranks, the left
                if x_gone <= y_gone:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    # the trie

    def _last(self, word: str, n: int, suffix: str, states: list[str]) -> str:
        """The last token of the encoding of the first n characters (+ word end), given the states of its shorter prefixes."""
        pairs = self.pairs
        for size in self.sizes.get(word[n - 3 : n] + suffix, ()) if n > 2 else ():
            if size <= n and (token := word[n - size : n] + suffix) in self.vocab and self.tree(token):
                left = states[n - size]
                if size == n or (pairs[left, token] if (left, token) in pairs else self.compatible(left, token)):
                    return token
        for size in range(min(n, 2), 0, -1):
            token = word[n - size : n] + suffix
            if token in self.vocab and self.tree(token) and (size == n or self.compatible(states[n - size], token)):
                return token
        raise ValueError(f"no token ends {word[:n]!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[str]]:
        """Tokens of distinct words of byte-level characters, by one depth-first pass over their trie."""
        out: dict[str, list[str]] = {}
        states, path = [""], ""  # states[k]: last token of the first k characters of the path
        for word in sorted(words):
            shared = len(commonprefix([path, word[:-1]]))
            del states[shared + 1 :]
            for k in range(shared + 1, len(word)):
                states.append(self._last(word, k, "", states))
            path = word[:-1]
            tokens, at = [self._last(word, len(word), END, states)], len(word)
            at -= len(tokens[0]) - len(END)
            while at > 0:
                tokens.append(states[at])
                at -= len(tokens[-1])
            out[word] = tokens[::-1]
        return out

    # texts

    def words_of(self, piece: str) -> list[str]:
        """The words of a piece without white space, as normalised."""
        if _PLAIN.fullmatch(piece):
            return _PLAIN_WORD.findall(piece.lower())
        return [w.translate(self.back).encode("latin-1").decode() for w, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(piece))]

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of new pieces into the store, those of new words first."""
        for lo in range(0, len(pieces), TRIE_PIECES):
            split = [(p, self.words_of(p)) for p in pieces[lo : lo + TRIE_PIECES]]
            wanted = {w for _, ws in split for w in ws}
            know = self.words.renewed(wanted)
            new = {w.encode().decode("latin-1").translate(self.bytes): w for w in wanted if w not in know}
            for level, tokens in self.encode_words(new).items():
                self.words.put(new[level], np.array([self.vocab[t] for t in tokens], "<u4").tobytes())
            for p, ws in split:
                self.store.put(p, know[ws[0]] if len(ws) == 1 else b"".join([know[w] for w in ws]))
            self.words.drop(wanted)

    def pieces(self, text: str) -> list[str]:
        return [p for p in _WHITE.split(text) if p] if _SEPARATORS.search(text) else text.split()

    def segments(self, text: str) -> list[list[str] | str]:
        """Lists of pieces, and the special tokens between them."""
        if not self.any_special.search(text):
            return [self.pieces(text)]
        out: list[list[str] | str] = []
        at = 0
        for m in self.any_special.finditer(text):
            out += [self.pieces(text[at : m.start()]), m[0]]
            at = m.end()
        return [*out, self.pieces(text[at:])]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [self.segments(t) for t in texts]
        pieces = {p for s in split for part in s if isinstance(part, list) for p in part}
        know = self.store.renewed(pieces)
        self._learn(sorted(p for p in pieces if p not in know))
        ids = lambda part: b"".join([know[p] for p in part]) if isinstance(part, list) else self.special[part].to_bytes(4, "little")
        out = [ids(s[0]) if len(s) == 1 else b"".join(map(ids, s)) for s in split]
        self.store.drop(pieces)
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_texts([text])[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by blanks: the file has no decoder. Ids without a token are left out, as the library does."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


_ENCODERS: dict[str, TrieBpe] = {}
KEPT[__name__] = _ENCODERS.clear


def encoder(path: str) -> TrieBpe:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieBpe(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, with ``ids`` and ``decoded`` where asked."""
    ship_package(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for big in batches:
            lengths = pa.compute.binary_length(big.column("text")).fill_null(0).to_numpy()
            lo = 0
            while lo < big.num_rows:
                n = max(1, min(AT_ONCE_DOCS, int(np.searchsorted(np.cumsum(lengths[lo : lo + AT_ONCE_DOCS]), AT_ONCE_CHARS, "right"))))
                b = big.slice(lo, n)
                lo += n
                got = bpe.encode_texts([t or "" for t in b.column("text").to_pylist()])
                decoded = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in got]
                columns = {
                    "doc_id": b.column("doc_id"),
                    "n_tokens": pa.array([len(x) // 4 for x in got], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in got],
                    "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
                }
                if keep_ids:
                    columns |= {"ids": pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in got], pa.list_(pa.int32())), "decoded": decoded}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)
