"""Watching a source tree: a stream of changes that drives incremental updates.

A Python streaming data source logs what came, changed and went whenever the listing (path, modification time, size) differs from the last
one; offsets are numbers of the log, so a batch that is read again has the same rows, whatever the tree is by then. The output directory is
never listed. ``foreachBatch`` then waits until the tree has been still for a while, so that a burst of changes makes one
update, and updates the graph; a failed update is repeated from the checkpointed offset.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from knotwork.plans.engine import Engine
from knotwork.runtime import scratch_path, ship_package
from knotwork.sources.discover import walk
from knotwork.streaming.changes import CHANGE, ChangeLog, Listing

#: Seconds without a change before an update, seconds of waiting at most, and between looks.
STILL, LONGEST, TICK = 1.0, 60.0, 0.25


def snapshot(root: str, skip: str = "") -> list[tuple[str, float, int]]:
    """The present listing; files that vanish meanwhile are left out."""
    out = []
    for rel, _ in walk(root, frozenset({skip}) if skip else frozenset()):
        try:
            s = os.stat(Path(root) / rel)
        except OSError:
            continue
        out.append((rel, s.st_mtime, s.st_size))
    return out


def fingerprint(rows: list[tuple[str, float, int]]) -> str:
    return hashlib.sha256(repr(rows).encode()).hexdigest()


class Logged(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.skip, self.log = options["path"], options.get("skip", ""), ChangeLog(options["log"])
        self.at: int | None = None
        self.listing: Listing = {}

    def initialOffset(self) -> dict:
        return {"change": 0}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self.log.last()
            self.listing = self.log.listing(self.at)
        now = {rel: (modified, size) for rel, modified, size in snapshot(self.root, self.skip)}
        self.at, self.listing = self.log.record(self.at, self.listing, now), now
        return {"change": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Logged(n, n + 1) for n in range(start["change"], end["change"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.log.rows(partition.start, partition.end)


class TreeSource(DataSource):
    """Format ``knotwork_tree``: options ``path``, ``skip`` and ``log``, the folder of the change log that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "knotwork_tree"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeReader(self.options)


def settled(root: str, skip: str = "", still: float = STILL, most: float = LONGEST) -> int:
    """Wait until the tree has not changed for ``still`` seconds, ``most`` at the longest; the number of changes seen."""
    seen, changes, end = fingerprint(snapshot(root, skip)), 0, time.monotonic() + most
    quiet = time.monotonic() + still
    while (now := time.monotonic()) < min(quiet, end):
        time.sleep(min(TICK, quiet - now))
        new = fingerprint(snapshot(root, skip))
        if new != seen:
            seen, changes, quiet = new, changes + 1, time.monotonic() + still
    return changes


def watch(engine: Engine, root: str | Path, interval: str = "2 seconds", once: bool = False, checkpoint: str | None = None, still: float = STILL) -> StreamingQuery:
    """Start updating the engine's graph whenever the tree changes; ``once`` handles what is there and stops."""
    spark: SparkSession = engine.spark
    ship_package(spark)
    spark.dataSource.register(TreeSource)
    skip = "" if "://" in str(engine.out) else os.path.realpath(engine.out)
    place = checkpoint or scratch_path(spark, "watch")
    tree = spark.readStream.format("knotwork_tree").options(path=str(Path(root).resolve()), skip=skip, log=f"{place}-log").load()

    def update(*_) -> None:
        settled(str(Path(root).resolve()), skip, still)
        engine.update(root)

    writer = tree.writeStream.foreachBatch(update).option("checkpointLocation", place)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
