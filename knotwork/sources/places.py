"""Places of files that stay when other files come and go.

A file's place is a number that grows in walk order. Walk order depends on paths alone, so files that stay keep their order, and
new files get numbers in the gap between their neighbours. Where a gap is full, or new files are many, all files get
new places, and the graph has to be merged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers between neighbours in a first numbering, and new files that are placed one by one.
GAP, MOST = 1 << 24, 100_000


def fresh(files: DataFrame, gap: int = GAP) -> DataFrame:
    """Files (``file_ord`` counting from 0) with places ``gap`` apart."""
    return files.withColumn("file_ord", (F.col("file_ord") + 1) * gap)


def between(runs: list[tuple[int, int]], labels: dict[int, int], gap: int = GAP) -> dict[int, int] | None:
    """Places for runs (first, last) of neighbouring new files, evenly spread between the places around them; None if one is full."""
    out: dict[int, int] = {}
    for first, last in runs:
        n, low = last - first + 1, labels.get(first - 1, 0)
        high = labels.get(last + 1, low + (n + 1) * gap)
        if high - low <= n:
            return None
        out |= {first + i: low + (high - low) * (i + 1) // (n + 1) for i in range(n)}
    return out


def placed(files: DataFrame, known: DataFrame, gap: int = GAP, most: int = MOST) -> tuple[DataFrame, bool]:
    """Files with the places that ``known`` (rel, file_ord) gives or leaves room for, and whether all known places were kept."""
    old = known.select("rel", F.col("file_ord").alias("place"))
    new = [r.file_ord for r in files.join(old, "rel", "left_anti").select("file_ord").orderBy("file_ord").limit(most + 1).collect()]
    if len(new) > most:
        return fresh(files, gap), False
    runs: list[list[int]] = []
    for i in new:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    spark = files.sparkSession
    around = spark.createDataFrame([(i,) for first, last in runs for i in (first - 1, last + 1)], "file_ord long").distinct()
    labels = {r.file_ord: r.place for r in files.join(F.broadcast(around), "file_ord").join(old, "rel").select("file_ord", "place").collect()}
    if (found := between([(a, b) for a, b in runs], labels, gap)) is None:
        return fresh(files, gap), False
    given = F.broadcast(spark.createDataFrame(list(found.items()), "file_ord long, given long"))
    x = files.join(old, "rel", "left").join(given, "file_ord", "left")
    return x.withColumn("file_ord", F.coalesce("place", "given")).select(*files.columns), True
