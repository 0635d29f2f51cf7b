"""The change log replays the same rows; net changes equal a plain fold; the source's offsets hold across restarts and changes of the tree."""

import os
import random

from pyspark.sql import functions as F

from knotwork.streaming import changes
from knotwork.streaming.changes import ChangeLog
from knotwork.streaming.watch import TreeReader, TreeSource

from tests.conftest import write_tree


def test_log(tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "SNAPSHOT_EVERY", 3)
    rng, log, listing, past, at = random.Random(3), ChangeLog(f"file://{tmp_path}/log"), {}, [{}], 0
    assert log.last() == 0 and log.listing(0) == {} and list(log.rows(0, 0)) == []
    for _ in range(10):
        new = {f"é {i}\n": (rng.randrange(3) / 2, rng.randrange(3)) for i in range(6) if rng.random() < 0.7}
        got = log.record(at, listing, new)
        assert got == at + (new != listing)
        if got > at:
            past.append(new)
        at, listing = got, new
    again = ChangeLog(str(tmp_path / "log"))
    assert again.last() == at and [again.listing(n) for n in range(at + 1)] == past
    now = past[2]
    for n in range(3, at + 1):
        now = changes.applied(now, [r[1:] for r in again.rows(n - 1, n)])
        assert now == past[n]
    assert {f.name.split(".")[1] for f in (tmp_path / "log").iterdir()} == {"changes", "snapshot"}


def test_source_replays(tmp_path):
    root = write_tree(tmp_path / "tree", {"a.py": "1", "b/c.md": "2", "d.py": ""})
    options = {"path": str(root), "log": str(tmp_path / "log")}
    r = TreeReader(options)
    first = r.latestOffset()
    assert first == {"change": 1} == r.latestOffset()
    (root / "a.py").unlink()
    write_tree(root, {"b/c.md": "longer", "e.txt": "x"})
    second = r.latestOffset()
    read = lambda reader, s, e: [row[:3] for p in reader.partitions(s, e) for row in reader.read(p)]
    want = [(2, "a.py", "deleted"), (2, "b/c.md", "changed"), (2, "e.txt", "added")]
    assert read(r, first, second) == want
    os.unlink(root / "e.txt")  # the tree is another one by now
    later = TreeReader(options)
    assert read(later, first, second) == want and [x[1] for x in read(later, later.initialOffset(), first)] == ["a.py", "b/c.md", "d.py"]
    assert later.latestOffset() == {"change": 3} and read(later, second, {"change": 3}) == [(3, "e.txt", "deleted")]


def test_stream_of_changes(spark, tmp_path):
    root = write_tree(tmp_path / "tree", {"a.py": "1", "b.py": "2"})
    spark.dataSource.register(TreeSource)

    def run():
        tree = spark.readStream.format("knotwork_tree").options(path=str(root), log=str(tmp_path / "log")).load()
        q = tree.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r.offset, r.rel, r.change) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(1, "a.py", "added"), (1, "b.py", "added")]
    (root / "a.py").unlink()
    assert run()[2:] == [(2, "a.py", "deleted")]


def test_net_changes(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 2, None]), rng.randrange(8), rng.choice([None, 1.0, 2.0]), rng.choice([True, False, False, None])) for i in range(60)]
    log = spark.createDataFrame(rows, "seq long, k long, day long, value double, gone boolean")
    got = changes.net_changes(log, ["k"], F.col("day"), ["seq"], "value", F.col("gone"))
    want, live = [], {}
    for day in range(8):
        before = dict(live)
        for _, k, d, value, gone in rows:
            if d == day:
                live.pop(k, None) if gone else live.__setitem__(k, value)
        for k in before.keys() | live.keys():
            if (k in before, before.get(k)) != (k in live, live.get(k)):
                want.append((k, day, "deleted" if k not in live else "changed" if k in before else "added", live.get(k)))
        assert sorted(map(repr, changes.state(got, ["k"], day).collect())) == sorted(f"Row(k={k!r}, value={v!r})" for k, v in live.items())
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert changes.net_changes(log.limit(0), ["k"], F.col("day"), ["seq"], "value", F.col("gone")).count() == 0
