import random
import zlib

import numpy as np

from knotwork.llm import langid

SYLLABLES = {"aa": ["ba", "ko", "mi"], "bb": ["sch", "ung", "ter"], "cc": ["eau", "ille", "tion"]}


def corpus(n=240, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        rows.append((i, " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(30)), lang, "clash"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy_and_edges(spark):
    odd = [(1000, None, "aa", ""), (1001, "", None, ""), (1002, "123 !!! 456", "aa", ""), (None, "sch ung ter schung", None, ""), (1004, "eau ille " * 30_000, None, ""), (5, "sch ung ter schung", "zz", "")]
    got = langid.identified(frame(spark, corpus() + odd)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 246
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(by[i].lang_pred == lang for i, _, lang, _ in corpus() if i != 5 and by[i].held_out)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[None].lang_pred == "bb" and by[1004].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from_and_empty(spark):
    assert [r.lang_pred for r in langid.identified(frame(spark, [(1, "abc", None, "")])).collect()] == ["und"]
    assert langid.identified(frame(spark, corpus()).limit(0)).count() == 0


def test_bundle_equals_direct_sum():
    texts = ["Hello, World", "ab", "", "日本語テスト", "x", "a b c"]
    got = langid.bundle([langid.letters_of(t) for t in texts])
    for t, v in zip(texts, got, strict=True):
        s = langid.letters_of(t).tolist()
        want = np.zeros(langid.DIMS)
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            want += np.roll(langid.letter_vector(a), 2).astype(int) * np.roll(langid.letter_vector(b), 1) * langid.letter_vector(c)
        assert np.array_equal(v, want)


def test_sample_is_bounded_and_stable(spark):
    docs = frame(spark, corpus())
    one, two = langid.learn(docs, per_language=5), langid.learn(docs.repartition(7), per_language=5)
    assert one[0] == two[0] == ["aa", "bb", "cc"] and np.allclose(one[1], two[1])


def test_repeated_rows(spark):
    rows = corpus()
    got = langid.identified(frame(spark, rows + rows[:5] * 3)).collect()
    assert len(got) == len(rows) + 15
    assert all(len({(r.lang_pred, round(r.score, 9)) for r in got if r.doc_id == x[0]}) == 1 for x in rows[:5])
