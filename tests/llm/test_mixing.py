import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from knotwork.llm import mixing


def fill(sizes):
    """Targets by the rule's own words: share by weight, stop at twice the size, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def rows_of(spark, docs, **options):
    df = spark.createDataFrame([(i, t, s, 7) for i, (s, t) in enumerate(docs)], "doc_id long, text string, source string, size int")
    return mixing.mix(df, **options).orderBy("doc_id").collect()


@pytest.mark.parametrize("block", [4, 16, 512])
def test_targets_and_taken(spark, block):
    sizes = {"a": 900, "b": 30, "c": 5, "Z": 400, None: 77, "empty": 0}
    docs = [(s, " ".join(["w"] * k)) for s, n in sizes.items() for k in ([n // 3, n - n // 3 - 1, 1] if n > 3 else [n])] + [("a", None), ("a", " \t\n")]
    got = rows_of(spark, docs, block_words=block)
    want = fill(sizes)
    for i, (s, t) in enumerate(docs):
        r = got[i]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
    for s in sizes:
        assert sum(r.taken for r, d in zip(got, docs, strict=True) if d[0] == s) == int(want[s] + 1e-9)


def test_repeated_rows_reruns_and_empty(spark):
    docs = [("a", "x y z")] * 50 + [("b", "x")] * 3
    assert rows_of(spark, docs) == rows_of(spark, docs)
    same = spark.createDataFrame([(1, "x y z", "a")] * 40 + [(None, "x", None)], "doc_id long, text string, source string")
    got = mixing.mix(same).collect()
    assert len(got) == 41 and max(r.taken for r in got) <= 6
    assert mixing.mix(same.limit(0)).count() == 0
    assert mixing.mix(same.select("doc_id", F.lit("").alias("text"), "source")).agg(F.sum("taken")).first()[0] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation_is_exact(spark, n):
    x = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("y"))
    assert sorted(r.y for r in x.collect()) == list(range(n))


def test_slots(spark):
    docs = spark.createDataFrame([(i, "w " * 97, f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    per = mixing.targets(mixing.measured(docs))
    s = mixing.slots(per, 50, 32).toPandas()
    n = len(s)
    assert sorted((s["shard"] * 32 + s["place"]).tolist()) == list(range(n))  # every place of every shard once
    assert s.groupby("src")["words"].sum().tolist() == [int(r.target + 1e-9) for r in per.orderBy("src").collect()]
    first = s[s["shard"] == 0].groupby("src").size() / 32
    assert first.max() < 0.9  # shards mix sources


def test_documents_of_the_mix(spark):
    docs = spark.createDataFrame([(i, "w " * 50, f"s{i % 2}", i) for i in range(400)], "doc_id long, text string, source string, __n long")
    got = mixing.mixed_documents(docs.drop("__n"))
    n = got.count()
    assert got.columns == ["doc_id", "text", "source"] and 500 < n < 700
    assert got.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def hashed(*values):
    """Spark's xxhash64 of integers (4 bytes), longs (given as 8 bytes) and texts."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else v.to_bytes(4, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def long(x):
    return x.to_bytes(8, "little", signed=True)


def place(x, n, *key):
    """Swap-or-not, step by step."""
    for r in range(mixing.ROUNDS if n > 1 else 0):
        partner = (hashed(*key, r, "round key") % n - x) % n
        if hashed(*key, r, long(max(x, partner))) % 2 == 1:
            x = partner
    return x


def brute(docs, L, S, seed=42):
    """taken of each document, and (shard, place) of every slot, word by word."""
    size = [len(t.split()) for _, t in docs]
    names = sorted({s for s, _ in docs})
    total = {s: sum(z for z, d in zip(size, docs, strict=True) if d[0] == s) for s in names}
    want = fill(total)
    taken, words = Counter(), {}
    for s in names:
        ids = [i for i, d in enumerate(docs) if d[0] == s]
        h = {i: hashed(seed, long(i), long(size[i])) for i in ids}
        n = math.ceil(math.sqrt(len(ids)))
        ids.sort(key=lambda i: (hashed(long(h[i]), "bucket") % n, h[i], i))
        words[s] = [i for i in ids for _ in range(size[i])]
    urn = []
    for src, s in enumerate(names):
        left, k, text = int(want[s]), 0, words[s]
        n_blocks, n_full = math.ceil(len(text) / L), len(text) // L
        while left > 0:
            turn, i = divmod(k, n_blocks)
            b = place(i, n_full, seed, src, long(turn)) if i < n_full else i
            rest = min(left, int(want[s]) - turn * len(text))
            got = text[b * L : (b + 1) * L][:rest]
            taken.update(got)
            left -= len(got)
            urn.append(src)
            k += 1
    counts = Counter()
    for k, src in enumerate(urn):
        counts[place(k, len(urn), seed, "shards") // S, src] += 1
    return taken, counts


def test_equals_brute_force(spark):
    docs = [(f"s{i % 4}", "w " * (1 + 37 * i % 61)) for i in range(150) if i % 4 != 3 or i % 12 == 3]
    taken, counts = brute(docs, 8, 16)
    got = rows_of(spark, docs, block_words=8, shard_slots=16)
    assert [r.taken for r in got] == [taken[i] for i in range(len(docs))]
    per = mixing.targets(mixing.measured(spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(docs)], "doc_id long, text string, source string")))
    drawn = mixing.draws(mixing.planned(per, 8, 16), 16).collect()
    assert {(r.shard, r.src): r.n for r in drawn} == counts


def test_blocks_of_the_mix(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 90), f"s{i % 3}", 1) for i in range(300)], "doc_id long, text string, source string, shard int")
    x = mixing.mixed_blocks(docs, block_words=50, shard_slots=8).toPandas()
    want = {r.doc_id: r.taken for r in mixing.mix(docs, block_words=50, shard_slots=8).where("taken > 0").collect()}
    assert x.groupby("doc_id")["n_words"].sum().to_dict() == want
    assert ((x["from_word"] >= 0) & (x["from_word"] + x["n_words"] <= x["doc_id"] % 90)).all()
    for _, b in x.sort_values("at").groupby(["shard", "place"]):  # pieces fill their block from its first word on, without gaps
        assert b["at"].tolist() == [0, *b["n_words"].cumsum().tolist()[:-1]] and b["n_words"].sum() <= 50 and b["block"].nunique() == b["src"].nunique() == 1


def test_the_draw_is_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    per = mixing.targets(mixing.measured(docs))
    plan = mixing.draws(mixing.planned(per))._jdf.queryExecution().optimizedPlan().toString()
    assert "shards" in plan and "Python" not in plan
    # taken depends on the counts drawn: other counts, other numbers of slots
    mixed = mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, (n#" in mixed


def test_long_text(spark):
    docs = spark.createDataFrame([(0, "w " * 300_000, "a"), (1, "x", "a"), (2, "y " * 1000, "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert got[0].size == 300_000 and got[0].taken + got[1].taken == int(got[0].target) and got[2].taken == 2000
