import numpy as np
import pytest

from knotwork.llm import topk


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")


def brute(rows, queries, k):
    ok = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in {i: v for i, v in ok if i in queries}.items():
        dot = lambda a, b: int((a[: min(len(a), len(b))] * b[: min(len(a), len(b))]).sum())
        best = sorted(((-dot(x, y), i if i is not None else 1 << 63, i) for i, y in ok if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(best)]
    return sorted(out, key=repr)


def run(spark, rows, queries, k=10):
    df = frame(spark, rows)
    got = topk.top_k(df, df.where(df.vec_id.isin(*queries)), k).collect()
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got), key=repr)


@pytest.mark.parametrize("scale", [1.0, 50.0])
def test_equals_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "GROW", 3)
    monkeypatch.setattr(topk, "ROWS", 2)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (scale * (centres[i % 6] + 0.2 * rng.normal(size=8)) * rng.uniform(0.1, 2)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # many equal vectors: ties by id
    queries = [0, 7, 100, 1003]
    assert run(spark, rows, queries) == brute(rows, queries, 10)


def test_edges(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, []), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [5.0, 5.0]), (8, [0.0, 0.0]), (9, [-1.0, -2.0])]
    for q in ([1], [3], [4], [8, 9]):
        assert run(spark, rows, q) == brute(rows, q, 10)
    assert run(spark, rows[3:7], [5]) == [] and run(spark, rows[:1], [1]) == []
    twice = [(1, [1.0]), (1, [1.0]), (2, [3.0]), (2, [3.0])]
    assert run(spark, twice, [1]) == [(1, 1, 2, 3 * 1024 * 1024), (1, 2, 2, 3 * 1024 * 1024)]
    # one id, two vectors: two queries, each the other's candidate
    assert run(spark, [(1, [1.0]), (1, [2.0]), (2, [3.0])], [1]) == [(1, 1, 2, 3 << 20), (1, 1, 2, 6 << 20), (1, 2, 1, 2 << 20), (1, 2, 1, 2 << 20)]
    df = frame(spark, rows)
    clash = frame(spark, twice).selectExpr("*", "1 AS query_id", "'x' AS mark", "2 AS q", "3 AS v", "4 AS cell", "5 AS norm", "6 AS shelf", "7 AS rank")
    assert topk.top_k(clash, clash).count() == 4
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_large_numbers_stay_exact():
    a, b = np.array([[2**31, 2**30 + 1]]), np.array([[2**30 - 3, 2**31 - 5]])
    assert topk.products(a, b)[0, 0] == 2**31 * (2**30 - 3) + (2**30 + 1) * (2**31 - 5)


def test_unclustered(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 24)))]
    assert run(spark, rows, [0, 100, 200]) == brute(rows, [0, 100, 200], 10)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for scale in (1, 1000):
        x = np.floor(scale * rng.normal(size=(500, 5)) + scale * rng.integers(-2, 3, size=(500, 1))).astype(int)
        q = np.floor(scale * rng.normal(size=(40, 7))).astype(int)
        pivots = topk.choose_pivots(x, 7)
        pivots[3] = 0
        d = topk._distances(x, pivots)
        cell = d.argmin(1) * topk.ANNULI + rng.integers(0, topk.ANNULI, len(x))
        r, norm = d.min(1), topk._norms(x)
        cells = np.array([(c, r[cell == c].min(), r[cell == c].max(), norm[cell == c].min(), norm[cell == c].max(), (cell == c).sum()) for c in np.unique(cell)])
        bound, true = topk.bounds(q, pivots, cells), topk.products(q, x)
        for i, c in enumerate(cells[:, 0]):
            assert (true[:, cell == c].max(1) <= bound[:, i]).all()


def test_index_excludes_most_products(spark):
    """Clustered vectors: a query multiplies a small share of the table, however large."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = np.repeat(centres, 100, axis=0) + 0.05 * rng.normal(size=(4000, 32))
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    made = []
    topk.top_k(df, df.where("vec_id % 100 = 0"), 10, products_made=made).count()
    assert sum(made) < 0.2 * 40 * 4000


def test_shelves():
    cells = np.zeros((5, 6))
    cells[:, 5] = [30, 30, 50, 250, 10]
    shelf, blocks = topk.shelves(cells, 100)
    assert shelf.tolist() == [0, 0, 1, 2, 3] and blocks.tolist() == [1, 1, 3, 1]
