"""Each stage against brute force on its own input, and the run as a whole."""

import re
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from knotwork.llm import jaccard, mixing, quality
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input, output) of every stage, each written and read back."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_quality(spark, stages):
    _, before, after = stages[0]
    model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.scored(before, model, "doc_id").where("score >= 0.7").collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(good)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(d in good for d, q in labels.items() if q == 1)


def test_one_of_each_group(stages):
    _, before, after = stages[1]
    groups = brute([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in groups})


def test_personal_data(stages):
    _, before, after = stages[2]
    old, new = ({r.doc_id: r for r in d.collect()} for d in (before, after))
    assert old.keys() == new.keys()
    find = re.compile(r"[a-z]+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b4\d{15}\b|\bAKIA[A-Z0-9]{16}\b|password=\w+")
    changed = 0
    for k, r in old.items():
        hits = set(find.findall(r.text))
        assert not [h for h in hits if h in new[k].text]
        assert new[k].n_chars - r.n_chars == len(new[k].text) - len(r.text)
        if not hits and not re.search(r"\d", r.text) and "@" not in r.text:
            assert new[k].text == r.text
        changed += bool(hits)
    assert changed


def test_mix(stages):
    _, before, after = stages[3]
    copies = {r.doc_id: r.copies for r in mixing.expected_copies(before).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter({d: n for d, n in copies.items() if n})
    assert 1.2 < after.agg(F.sum(F.length("text"))).first()[0] / before.agg(F.sum(F.length("text"))).first()[0] < 1.8


def test_encoding(stages):
    _, before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in before.collect()}
    got = after.collect()
    assert len(got) == before.count()
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in got)


def test_registered(spark, stages):
    assert {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", q)[0] for q in __spark_entry__.queries() if q.startswith("op")}
    run = __spark_entry__.queries()["pipeline"](spark, SF)
    assert sorted(map(tuple, run.select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, stages[4][2].select("doc_id", "ids_sha256").collect()))


def test_clashing_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns({"n": F.lit(1), "score": F.lit("x"), "size": F.lit(2), "id": F.lit(3), "found": F.lit(4)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert {"n", "score", "size", "id", "found"} <= set(docs.columns)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_nulls_repeats_and_empty_texts(spark):
    """Rows with nulls in any column, empty texts and repeated rows go through every stage by its stated rules."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id", "left_semi").limit(40).select(*docs.columns)
    first = good.first()
    odd = spark.createDataFrame([(None, first.text, "en", "s", 10), (None, None, None, None, None), (900_001, None, "en", "s", 0), (900_002, "", None, None, None), (900_003, first.text, None, None, None), (first.doc_id, first.text, first.lang, first.source, first.n_chars)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        x = stage(spark, good.unionByName(odd), SF)
        assert x.dtypes == docs.dtypes
        rows = x.collect()
        ids = Counter(r.doc_id for r in rows)
        if name.startswith("n-gram"):
            assert ids[None] == 2 and ids[first.doc_id] == 1 and ids[900_001] == ids[900_002] == 1 and ids[900_003] == (first.doc_id > 900_003)
        if name == "PII":
            assert sum(ids.values()) == good.count() + 6 and [r.text for r in rows if r.doc_id in (900_001, 900_002)] == [None, ""]
        if name.startswith("mixing"):
            assert not any(r.text in (None, "") for r in rows if r.doc_id is not None) and ids[first.doc_id] <= 4
    encoded = corpus_pipeline.STAGES[-1][1](spark, good.unionByName(odd), SF).collect()
    assert len(encoded) == good.count() + 6 and {r.n_tokens for r in encoded if r.doc_id in (900_001, 900_002)} == {0}


def test_unlike_texts_under_one_id(spark):
    """Nothing is lost where rows share an id: only equal rows, and documents that link, are merged."""
    words = [f"w{i}" for i in range(60)]
    a, b, near_a = " ".join(words), " ".join(reversed(words)), " ".join([*words[:-1], "other"])
    rows = [(1, a, 5), (1, b, 6), (1, a, 5), (2, near_a, 7), (3, "", 8), (3, "alone", 9), (None, a, 1), (None, a, 1), (7, b + " tail", 2), (9, None, 3), (9, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own int")
    got = sorted(((r.doc_id, r.text, r.own) for r in jaccard.representatives(df).collect()), key=repr)
    assert got == sorted([(1, a, 5), (1, b, 6), (3, "", 8), (3, "alone", 9), (None, a, 1), (None, a, 1), (9, None, 3)], key=repr)
    assert got == sorted(((r.doc_id, r.text, r.own) for r in jaccard.representatives(df.repartition(7)).collect()), key=repr)
