"""The registered queries with SQL equal it over the small tables; the others give a row for each row of their table."""

from pathlib import Path
from types import SimpleNamespace

import duckdb
import pytest

from knotwork.llm import registry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the tables are not here")
TABLE = {"op2_vector_dedup": "embeddings", "op7_warc": "pages", "op13_whitening": "embeddings"}
#: Rows for each row of the table.
TIMES = {"op13_whitening": 8}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, str(SF))
    got = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLE:
        table = TABLE.get(name, "documents")
        assert len(got) == spark.read.parquet(f"{SF}/{table}.parquet").count() * TIMES.get(name, 1)
        return
    db = duckdb.connect()
    for p in SF.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = db.execute(registry.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = [df.columns.index(c) for c in names]
    assert sorted((tuple(r[i] for i in order) for r in got), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize(("name", "column", "least"), [("op4_quality", "predicted", 0.95), ("op8_langid", "lang_pred", 0.97)])
def test_held_out_accuracy(spark, name, column, least):
    """On the quarter that nothing was learned from."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r[column] for r in registry.QUERIES[name](spark, sf).where("held_out").collect()}
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet" if name == "op4_quality" else f"{sf}/documents.parquet").select("doc_id", "quality" if name == "op4_quality" else "lang").collect()}
    both = [(v, truth[k]) for k, v in got.items() if truth.get(k) is not None]
    assert len(both) > 50 and sum(a == b for a, b in both) >= least * len(both)


@pytest.mark.parametrize("given", [None, "mine"])
def test_pii_key_on_a_cluster(given):
    """A cluster session without the setting gets a key of its own, the same in all its queries, and none that stands in the sources."""
    session = lambda: SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: given), sparkContext=SimpleNamespace(master="spark://host:7077"))
    one, other = session(), session()
    key = registry.pii_key(one)
    assert key and key == registry.pii_key(one) != registry.TEST_KEY
    assert (key == registry.pii_key(other)) == bool(given)
