import random
import zlib

import numpy as np

from knotwork.llm import quality


def corpus(n=400, seed=2):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("aeioubdst") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(30, 80))]
        good = i % 4 > 0
        text = " ".join(words) + "." if good else "!! ".join(w.upper() for w in words)
        rows.append((i, text, "xx", f"s{good}", len(text), "clash"))
        labels.append((i, int(good), 0))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = quality.classified(*frames(spark, rows, labels)).toPandas().merge(__import__("pandas").DataFrame(labels, columns=["doc_id", "quality", "toxic"]))
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert (got[got["held_out"]]["predicted"] == got[got["held_out"]]["quality"]).mean() > 0.98
    assert (got["predicted"] == (got["score"] >= 0.7)).all() and got["score"].between(0, 1).all()


def test_scores_ignore_language_source_and_id(spark):
    rows, labels = corpus(120)
    model = quality.train(*frames(spark, rows, labels))
    docs = frames(spark, [(1, "some text", "a", "b", 9, ""), (2, "some text", None, None, 9, "")], labels)[0]
    a, b = quality.scored(docs, model, "doc_id").collect()
    assert a.score == b.score


def test_edges(spark):
    rows, labels = corpus(120)
    odd = [(None, None, None, None, None, ""), (500, "", "x", "y", 0, ""), (501, "word " * 200_000, "x", "y", None, ""), (501, "word", "x", "y", -5, ""), (502, " \n\x00|", "x", "y", 3, "")]
    docs, known = frames(spark, rows + odd, labels + [(501, None, 0), (None, 1, 0), (502, 7, 0)])
    got = quality.classified(docs, known).collect()
    assert len(got) == 125 and all(0 <= r.score <= 1 for r in got)
    keep = quality.accepted(docs, known)
    assert keep.columns == docs.columns and keep.dtypes == docs.dtypes
    none = quality.classified(docs, known.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 0)}
    assert quality.classified(docs.limit(0), known).count() == 0
    assert min(r.score for r in quality.classified(docs, known.where("quality = 1")).collect()) > 0.5


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    m = quality.FactorisationMachine(0.3, rng.normal(size=quality.DIMS), rng.normal(0, 0.1, (quality.DIMS, quality.RANK)))
    rows = [quality.features(t, n) for t, n in (("a b c a", 7), ("", None), ("X!! Y|", 6))]
    for (idx, val), got in zip(rows, m.scores(rows), strict=True):
        z = m.bias + m.linear[idx] @ val
        for i in range(len(idx)):
            for j in range(i):
                z += m.factors[idx[i]] @ m.factors[idx[j]] * val[i] * val[j]
        assert np.isclose(got, 1 / (1 + np.exp(-z)))


def test_sample_is_bounded_and_stable(spark):
    docs, known = frames(spark, *corpus(200))
    a, b = quality.train(docs, known, 50), quality.train(docs.repartition(5), known.repartition(3), 50)
    assert np.array_equal(a.linear, b.linear)
