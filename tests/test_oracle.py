"""Every registered graph query runs, and equals its SQL, over small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from knotwork.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, str(DATA))
    got = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLE:
        assert got
        return
    want = db.execute(registry.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(got, df.columns) == canonical(want.fetchall(), names)


def test_flagship(spark):
    assert registry.flagship(spark, str(DATA)).count() > 0
