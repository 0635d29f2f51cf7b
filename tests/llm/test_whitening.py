"""Whitening against numpy over all rows at once."""

import math

import numpy as np
import pytest

from knotwork.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, x string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def plain(vectors):
    x = np.floor(1024 * np.array(vectors)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    m = n * x - s
    c = m / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:8]
    return [sum(int(a) ** 2 for a in r) for r in m], c @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 12)) * np.arange(1, 13) / 10).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(5, vectors[9]), (None, vectors[0])]
    bad = [(900, None), (901, [None] * 12), (902, [math.nan] * 12), (903, [math.inf] + [0.0] * 11), (904, []), (905, [1.0] * 13)]
    got = whitening.whitened(frame(spark, rows + bad))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    assert len(got) == 302 * 8 and {r.n for r in got} == {302} and {r.component for r in got} == set(range(1, 9))
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    deviation, w, explained = plain([v for _, v in rows])
    for k in range(8):
        mine = {r.vec_id: r for r in got if r.component == k + 1}
        sign = np.sign(w[7, k]) * np.sign(mine[7].whitened)
        for i in range(300):
            if i != 5:  # an id of two rows
                assert mine[i].whitened == pytest.approx(sign * w[i, k], abs=1e-9) and mine[i].deviation == deviation[i] and mine[i].explained == pytest.approx(explained[k], rel=1e-9)


def test_degenerate_tables(spark):
    one = whitening.whitened(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)]
    line = whitening.whitened(frame(spark, [(i, [i / 8, i / 4, 1.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1, 2, 3} and line[0].identity_error < 1e-9
    assert all(r.whitened == 0 and r.explained == 0 for r in line if r.component > 1)
    assert whitening.whitened(frame(spark, [(1, None)])).count() == 0 and whitening.whitened(frame(spark, []).limit(0)).count() == 0


def test_large_components(spark):
    """Integers beyond 2^20 from the mean are centred by parts, and sums of squares beyond 64 bits are null."""
    rows = [(i, [float(1 << (i * 3)), 1.0]) for i in range(12)]
    got = {r.vec_id: r for r in whitening.whitened(frame(spark, rows)).where("component = 1").collect()}
    x = [math.floor(1024 * v[0]) + 100_000 for _, v in rows]
    for i in range(12):
        exact = (12 * x[i] - sum(x)) ** 2
        assert got[i].deviation == (exact if exact < 2**63 else None)
    assert got[0].identity_error < 1e-6
