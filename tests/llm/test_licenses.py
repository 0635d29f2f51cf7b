"""License scans against the definition, and the plan."""

import re

import pytest

from knotwork.llm import licenses

BASE = licenses.PHRASES
NOTICE = licenses.TEMPLATES[6][1]


def plain(text):
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def rows_of(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, label string, at int")
    return {r.doc_id: r for r in licenses.scanned(df, **more).collect()}


TEXTS = [
    None, "", " \n--", "MIT", "mit license", "The MIT-License; and MIT LICENSE mit license", "CC BY cc by-nc 4.0 CC_BY", "GNU General Public License", "gnu general public licenses", "gnu gnu general public license",
    "Apache License", "apache license mit license cc by gnu general public license", "K mit license İ", "é mit license", "mit license " * 9000, "a " * 4095 + "mit license b cc by", "x " * 4094 + "gnu general public license",
]


def test_base_places_by_definition(spark):
    got = rows_of(spark, TEXTS)
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(t), t
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score == 1.0 or not r.n_base)


@pytest.mark.parametrize("chunk", [4, 7])
def test_chunks_do_not_show(spark, monkeypatch, chunk):
    texts = [t for t in TEXTS if len(t or "") < 1000] + [f"word {NOTICE} word", "a b c d e f gnu general public license g"]
    whole = rows_of(spark, texts)
    monkeypatch.setattr(licenses, "CHUNK", chunk)
    assert rows_of(spark, texts) == whole


def test_notices_with_changes(spark):
    words = NOTICE.split()
    texts = [
        f"intro {NOTICE} outro", " ".join(words[:8] + ["very", "new"] + words[8:]), " ".join(words[:6] + words[8:]), " ".join(words[:9]), "nothing to see under the sun of charge to any person",
        " ".join(words[:10]) + " filler" * 60 + " " + " ".join(words[10:]), "Licensed under CC BY-NC 4.0.", f"{NOTICE} and again {NOTICE}",
    ]
    got = rows_of(spark, texts)
    assert [got[i].labels for i in range(8)] == ["mit", "mit", "mit", "", "", "", "cc-by,cc-by-nc-4.0", "mit"]
    assert [got[i].score for i in (0, 3, 4)] == [1.0, 0.0, 0.0] and 0.7 <= got[1].score < 1
    assert got[0].found[0].first_word == 1 and got[0].found[0].last_word == len(re.findall(licenses.WORD, NOTICE.lower())) and len(got[7].found) == 2


def test_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "mit license")] * 5 + [(None, "cc by")] * 2 + [(1, "other")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_base, r.labels) for r in licenses.scanned(df).collect())
    assert got == [(0, 1, "cc-by")] * 2 + [(1, 0, "")] + [(1, 1, "mit")] * 5
    assert licenses.scanned(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="at most"):
        licenses.template_grams(spark, templates=(("x", "w " * 200_000),))


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir')}/licenses_plan")
    plan = licenses.scanned(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
