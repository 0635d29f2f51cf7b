"""The index finds what the scan of one question finds."""

import pytest
from pyspark.sql import functions as F

from knotwork.operators import search, text_index, traverse
from knotwork.schema import NODES

NAMES = [None, "", "Login", "auth.Login", "pkg::login_user", "relogin", "log", "logic", "a.lo", "lo", "LONGEST.loging", "αβγlog", "x", "user login", "aaaa", "login.aaaaaaab"]
TERMS = ["login", "lo", "logi", "logins", "user", "aaaaaaaaaa", "aaaa", "zz", "n7", "n1", "pkg", "log_x", "x"]


@pytest.mark.parametrize("few", [True, False])
def test_equals_the_scan(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(text_index, "BROADCAST_ROWS", 0)
    rows = [{"id": f"n{i}", "type": "class" if i % 3 else None, "name": n} for i, n in enumerate(NAMES)]
    nodes = spark.createDataFrame([tuple(r.get(c) for c in [x.split(" ")[0] for x in "id,type,name,src,language,level,line,confidence,community,extras,ord".split(",")]) for r in rows], NODES)
    asked = [("a", ["login", "user", "lo"]), ("b", ["zz"]), ("c", ["aaaa", "logins", "n1", "n1"]), ("d", [None, "x"])] + [(t, [t]) for t in TERMS]
    q = spark.createDataFrame([(k, t) for k, ts in asked for t in ts], "q string, term string")
    got = {}
    for r in text_index.question_seeds(nodes, q, ["q"], 100).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.id, r.score))
    for k, ts in asked:
        ts = list(dict.fromkeys(t for t in ts if t and len(t) >= 2))
        want = [(r.id, r.score) for r in search.seeds(nodes, ts, 100).collect()] if ts else []
        assert got.get(k, []) == want, k
    assert text_index.question_seeds(nodes.limit(0), q, ["q"]).count() == 0 == text_index.question_seeds(nodes, q.limit(0), ["q"]).count()
    assert all(len(v) == 2 for v in [[x for x in text_index.question_seeds(nodes, q, ["q"], 2).collect() if x.q == "login"]])


def test_lookups_hold_what_nodes_have(spark):
    """Terms that meet no node leave no lookup, so their number does not decide how the index is joined; repeated nodes count each time."""
    nodes = spark.createDataFrame([("n1", "class", "login"), ("n1", "class", "login"), ("n2", "class", "login"), ("n3", None, "logic")], "id string, type string, name string")
    terms = spark.createDataFrame([("login",), ("qwertz",), ("logi",), ("asdfgh",)], "term string")
    look = text_index.lookups(text_index.postings(nodes), terms)
    assert {(r.term, r.inside) for r in look.collect()} == {("login", True), ("login", False), ("logi", True), ("logi", False)}
    got = text_index.question_seeds(nodes, terms.withColumn("q", F.lit(1)), ["q"]).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("n1", 31), ("n2", 16), ("n3", 8)]
