"""Codes by parts against a plain loop over all vectors."""

import hashlib
import math

from knotwork.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, h1 string, pos int, n string"


def plain(rows, parts=8, entries=16, rounds=6):
    """{row number: (code, error)}, label sums, and the digest."""
    kept = [(i, v, [math.floor(4096 * c) for c in x], lab) for i, (v, x, lab) in enumerate(rows) if x and all(c is not None and math.isfinite(c) for c in x)]
    width = -(-len(kept[0][2]) // parts)
    cut = lambda x: [x[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:entries]
    books = [[cut(r[2])[p] for r in first] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(assign(p, cut(r[2])[p])[1], []).append(cut(r[2])[p])
            for i, g in groups.items():
                books[p][i] = [math.floor(sum(c) / len(g)) for c in zip(*g, strict=True)]
    out, labels = {}, {}
    for i, _, x, lab in kept:
        found = [assign(p, cut(x)[p]) for p in range(parts)]
        out[i] = ("".join(f"{c:02x}" for _, c in found), sum(d for d, _ in found))
        labels[lab] = labels.get(lab, 0) + out[i][1]
    text = ",".join(str(v) for b in books for e in b for v in e)
    return {i: (*o, labels[rows[i][2]]) for i, o in out.items()}, hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = vector_codes.coded(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want, digest = plain(rows)
    got = got.collect()
    assert {r.codebooks_sha256 for r in got} == {digest}
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == sorted(((rows[i][0], *w) for i, w in want.items()), key=repr)


def test_against_a_plain_loop(spark):
    import random

    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(16)], r.choice([1, 2, None])) for i in range(60)]
    rows += [(100 + i, rows[0][1], 7) for i in range(40)]  # copies
    rows += [(7, rows[3][1], 1), (7, [0.0] * 16, 2), (None, [0.5] * 16, 1)]  # repeated and null ids
    rows += [(900, None, 1), (901, [None] + [0.0] * 15, 1), (902, [math.nan] * 16, 1), (903, [math.inf] * 16, 1), (904, [], 2)]
    check(spark, rows)


def test_hot_keys_take_the_broadcast_way(spark, monkeypatch):
    from knotwork.llm import by_key

    monkeypatch.setattr(by_key, "FEW", 3)
    monkeypatch.setattr(by_key, "SHARE", 0.05)
    check(spark, [(i, [[0.1, -0.3, 0.7][i % 3] if i < 30 else i / 50] * 8, i % 4 if i % 5 else None) for i in range(50)])


def test_few_vectors_uneven_parts_and_other_lengths(spark):
    check(spark, [(i, [i / 7, -i / 5, 1.0, 0.25, i / 3, 0.0, 0.5, -0.5, 0.125, i / 9, 0.3], None) for i in range(5)])
    df = spark.createDataFrame([(1, [0.1] * 8, 1), (2, [0.2] * 8, 1), (3, [0.3] * 9, 1), (4, [5000.0] * 8, 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(r.vec_id for r in vector_codes.coded(df).collect()) == [1, 2]
    assert vector_codes.coded(df.limit(0)).count() == 0
