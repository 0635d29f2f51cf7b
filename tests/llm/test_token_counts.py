import random

import public_tokenizers
import pytest

from knotwork.llm import token_counts as tc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return tc.Codec(RANKS, public_tokenizers.PATTERN)


def words(rnd, n):
    return "".join(rnd.choice(["the ", "cat's ", "12 ", "  ", "\n\n", "é", "x" * 9, "!?", " 日本", "\t"]) for _ in range(n))


def test_edits_equal_full_counts(codec):
    rnd = random.Random(3)
    for _ in range(60):
        tree = tc.CountTree(words(rnd, rnd.choice([0, 3, 60, 900])), codec)
        for _ in range(25):
            tree.edit(rnd.choice([0, len(tree.text), rnd.randint(0, len(tree.text) + 5), -3]), rnd.choice([0, 1, 7, 300, -1]), rnd.choice(["", " ", "'s", "a", words(rnd, 5), words(rnd, 400)]))
            assert tree.tokens == len(codec.bpe.encode_ordinary(tree.text))
            sizes = [s for leaf in tree.sizes for s in leaf]
            assert sizes == [len(p) for p in codec.split(tree.text)]
            for below, level in zip(tree.levels, tree.levels[1:], strict=False):
                assert [below[i * tc.FANOUT : (i + 1) * tc.FANOUT].sum(0).tolist() for i in range(len(level))] == level.tolist()


def test_only_the_region_is_encoded_again(codec):
    tree = tc.CountTree("plain words here " * 5000, codec)
    tree.edit(40_000, 5, "other")
    assert tree.reencoded < 10


def test_table_of_edits_and_edges(spark, codec):
    docs = spark.createDataFrame([(1, "one two three", "c"), (2, None, "c"), (3, "", "c"), (None, "no id", "c"), (4, "w " * 100_000, "c"), (5, "same", "c"), (5, "same", "c")], "doc_id long, text string, edits string")
    edits = spark.createDataFrame(
        [(1, 2, 0, 3, "1"), (1, 1, 99, 5, " four"), (2, 1, 4, 4, "new"), (4, 1, 100_000, 50, None), (None, 1, 0, 1, "x"), (77, 1, 0, 1, "x"), (5, 1, None, None, "a ")],
        "doc_id long, seq int, position long, delete long, insert string",
    )
    got = tc.counted(tc.with_edits(docs, edits), RANKS, public_tokenizers.PATTERN, keep_text=True).collect()
    texts = sorted(((r.doc_id or 0), r.text_edited[:40], r.n_edits) for r in got)
    assert texts == [(0, "no id", 0), (1, "1 two three four", 2), (2, "new", 1), (3, "", 0), (4, ("w " * 100)[:40], 1), (5, "a same", 1), (5, "a same", 1)]
    for r in got:
        assert r.n_tokens_edited == len(codec.bpe.encode_ordinary(r.text_edited))
    script = tc.counted(tc.edit_script(docs), RANKS, public_tokenizers.PATTERN, keep_text=True).collect()
    assert len(script) == 7 and all(r.n_edits == 4 and r.n_tokens_edited == len(codec.bpe.encode_ordinary(r.text_edited)) for r in script)
    assert tc.counted(tc.edit_script(docs.limit(0)), RANKS, public_tokenizers.PATTERN).count() == 0
