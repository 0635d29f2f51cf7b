import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from knotwork.llm import bpe_trie

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "   ", "Hello, World's 123 don't we'll!!", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|STARTOFTEXT|> <|endoftext",
    "ΑΣΣ ΣΟΦΟΣ İstanbul ẞ ½²³ ﬁ été é ́x", "\x1c\x1d a\x1cb \x85x\xa0y z​q", "日本語 テスト 안녕 😀👩‍👩‍👧 مرحبا",
    "a" * 300, "''''''s's 'S 'RE", "\x00\x01 ﻿", "the" * 500, "ſ K Å ŉ ǰ", "!!!???...---___===", "퟿ " + chr(0x10FFFF), "µ ª º ÿ × ÷",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def bpe():
    return bpe_trie.TrieBpe(PATH)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_equal_the_library(bpe, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == want and bpe.decode(want) == library.decode(want, skip_special_tokens=False)


def test_random_words_equal_the_library(bpe, library):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdeèüst'1") for _ in range(rnd.randint(1, 14))) for _ in range(5000)]
    parts = [w.replace("</w>", "") for w in bpe.vocab if w.isascii()]
    words += ["".join(rnd.sample(parts, rnd.randint(1, 4))) for _ in range(10000)]
    text = " ".join(words)
    assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_shared_prefixes_are_encoded_once(bpe, monkeypatch):
    calls = []
    plain = bpe._last
    monkeypatch.setattr(bpe, "_last", lambda word, n, suffix, states: calls.append(word[:n]) or plain(word, n, suffix, states))
    bpe.encode_words({"interest", "interested", "interesting", "interests"})
    prefixes = {w[:k] for w in ("interest", "interested", "interesting", "interests") for k in range(1, len(w))}
    assert len(calls) == len(prefixes) + 4  # each prefix once, each word end once


def test_stores_turn_over(bpe, library, monkeypatch):
    small = bpe_trie.TrieBpe(PATH)
    small.store, small.words = bpe_trie.Store(20), bpe_trie.Store(15)
    rnd = random.Random(2)
    for _ in range(30):
        t = " ".join("".join(rnd.choice("abé!") for _ in range(3)) for _ in range(25))
        assert small.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_query_rows(spark, library):
    rows = [(i, t, 1) for i, t in enumerate([*ODD, "long word " * 50_000])] + [(None, None, 1), (0, "again", 1), (0, "again", 1)]
    got = bpe_trie.encoded(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH, keep_ids=True).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in got}
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) in by
    assert all(r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest() for r in got)
    assert bpe_trie.encoded(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
