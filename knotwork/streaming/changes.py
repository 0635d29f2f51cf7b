"""Changes of a listing as a log that can be replayed: what came, changed and went, by offset.

Log files are JSON lines in a folder of any store; file n holds the changes of offset n and never changes, so reading from one offset to another
gives the same rows at any time. Every ``SNAPSHOT_EVERY`` offsets the whole listing is written too, so a restart reads one snapshot and
at most that many files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOT_EVERY = 64
CHANGE = "offset long, rel string, change string, modified double, size long"
#: A listing: path -> (modification time, size).
Listing = dict[str, tuple[float, int]]


def difference(before: Listing, after: Listing) -> list[tuple[str, str, float | None, int | None]]:
    """(path, change, modified, size), by path; a deletion has neither time nor size."""
    out = [(rel, "deleted", None, None) for rel in before.keys() - after.keys()]
    out += [(rel, "changed" if rel in before else "added", *now) for rel, now in after.items() if before.get(rel) != now]
    return sorted(out)


def applied(listing: Listing, rows: list[tuple[str, str, float | None, int | None]]) -> Listing:
    """The listing after changes."""
    gone = {rel for rel, change, *_ in rows if change == "deleted"}
    return {rel: now for rel, now in listing.items() if rel not in gone} | {rel: (modified, size) for rel, change, modified, size in rows if change != "deleted"}


class ChangeLog:
    """The log in a folder. One writer; readers may be anywhere the store can be opened."""

    def __init__(self, uri: str):
        self.store, self.path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)

    def _read(self, name: str) -> list[list]:
        with self.store.open_input_stream(f"{self.path}/{name}") as f:
            return [json.loads(line) for line in f.read().decode("utf-8").splitlines()]

    def _write(self, name: str, rows: list) -> None:
        """Written beside and renamed, so a file is whole or absent."""
        self.store.create_dir(self.path, recursive=True)
        with self.store.open_output_stream(f"{self.path}/{name}.new") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode("utf-8"))
        self.store.move(f"{self.path}/{name}.new", f"{self.path}/{name}")

    def _offsets(self, suffix: str) -> list[int]:
        files = self.store.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(suffix)) for f in files if f.base_name.endswith(suffix))

    def last(self) -> int:
        """The last offset, 0 in an empty log."""
        return max(self._offsets(".changes"), default=0)

    def rows(self, start: int, end: int) -> Iterator[tuple]:
        """(offset, path, change, modified, size) after ``start`` up to ``end``."""
        for n in range(start + 1, end + 1):
            for row in self._read(f"{n}.changes"):
                yield (n, *row)

    def listing(self, at: int) -> Listing:
        """The listing at an offset: the last snapshot before it, and the changes since."""
        base = max((n for n in self._offsets(".snapshot") if n <= at), default=0)
        now = {rel: (modified, size) for rel, modified, size in self._read(f"{base}.snapshot")} if base else {}
        for n in range(base + 1, at + 1):
            now = applied(now, [tuple(r) for r in self._read(f"{n}.changes")])
        return now

    def record(self, offset: int, before: Listing, after: Listing) -> int:
        """Log a new listing after ``offset``; the offset that holds it, the same one where nothing changed."""
        rows = difference(before, after)
        if not rows:
            return offset
        if (offset + 1) % SNAPSHOT_EVERY == 0:
            self._write(f"{offset + 1}.snapshot", [(rel, *now) for rel, now in sorted(after.items())])
        self._write(f"{offset + 1}.changes", rows)
        return offset + 1


def net_changes(log: DataFrame, keys: list[str], offset: Column, order: list[str], value: str, gone: Column) -> DataFrame:
    """(keys, offset, change, value): what each offset changed for each key in the end, from a log of single changes.

    A key's changes within an offset are reduced to the last one by ``order`` before the shuffle, so a hot key costs its offsets, not its rows. Keys
    that came and went within one offset, and changes to an equal value, leave no row; a null value is a value. ``gone``
    marks deletions, whose value is null.
    """
    last = log.withColumn("offset", offset).groupBy(*keys, "offset").agg(F.max_by(F.struct(F.coalesce(gone, F.lit(False)).alias("gone"), F.col(value).alias("value")), F.struct(*order)).alias("now"))
    x = last.withColumn("before", F.lag("now").over(Window.partitionBy(*keys).orderBy("offset")))
    was, is_ = F.coalesce(~F.col("before.gone"), F.lit(False)), ~F.col("now.gone")
    change = F.when(is_ & ~was, "added").when(was & ~is_, "deleted").when(was & is_ & ~F.col("before.value").eqNullSafe(F.col("now.value")), "changed")
    return x.select(*keys, "offset", change.alias("change"), F.when(is_, F.col("now.value")).alias("value")).where("change IS NOT NULL")


def state(changes: DataFrame, keys: list[str], at: int) -> DataFrame:
    """(keys, value) that live at an offset, from net changes."""
    last = changes.where(F.col("offset") <= at).groupBy(*keys).agg(F.max_by(F.struct("change", "value"), "offset").alias("x"))
    return last.where("x.change <> 'deleted'").select(*keys, F.col("x.value").alias("value"))
