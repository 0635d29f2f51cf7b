"""Operator 13: whitening of embeddings by their principal components.

Each component c becomes the integer x = floor(1024 c) + 100000. Sums of every dimension are exact, so rows can be centred
exactly: with S = n q + r, n x - S = n (x - q) - r is a small integer. The centred rows, n x - S over n, are an MLlib ``RowMatrix``;
its Gramian, summed by a tree over the partitions, divided by n is the covariance. Its eigenvectors are found on the driver (a
matrix of d by d), those of the largest eigenvalues, each over the root of its eigenvalue, are broadcast, and ``mapInPandas`` projects
the rows. The covariance of what comes out is measured the same way, centred by its own means, against the identity.

What the driver holds is bounded by the dimension alone: d sums, and d by d covariances. No row is shuffled; tasks send sums.

Defined results. Vectors that are null, empty, or hold null or non-finite components, or one of 2^42 or more in magnitude (whose
integers leave the exact range), take no part. So do vectors of another length than most have (ties: the longest). A deviation
beyond 64 bits is null. Null and repeated vec_ids: rows of their own. Fewer dimensions than components: as many as there are.
Components without variance (an eigenvalue below 1e-12 of the largest, as of equal rows or a single one) have whitened and explained 0
and do not count in identity_error. Equal eigenvalues: any basis of their space. Signs: the entry of largest magnitude is
positive. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.runtime import cut, ship_package

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Magnitude of a component from which its integer is not exact; deviations from the mean that are multiplied by n as integers.
LIMIT, NEAR = 2.0**42, 1 << 20
#: Eigenvalues below this share of the largest one are no variance.
RANK = 1e-12
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x) of the vectors that take part, of any length."""
    v = F.col("embedding")
    inside = lambda c: F.abs(c.cast("double")) < LIMIT
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & inside(c))
    # filters may be evaluated in any order, so the integers do not rely on them
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.when(inside(c), F.floor(c.cast("double") * scale) + offset)).alias("x"))


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows of the commonest length of ``x``, and that length; 0 if there are none."""
    best = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.where(F.size("x") == best.d), best.d) if best else (rows, 0)


def covariance(rows: DataFrame, column: Column, n: int, d: int) -> np.ndarray:
    """The Gramian of ``column``, an array of d centred doubles, over n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, n, d).computeGramianMatrix().toArray() / n


def components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their unit eigenvectors as columns, the entry of largest magnitude positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:k]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)


def squares(m: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows of integers, None beyond 64 bits."""
    if float(np.abs(m).max(initial=0)) ** 2 * m.shape[1] < 2.0**62:
        return (m * m).sum(1).tolist()
    sums = (sum(int(x) ** 2 for x in row) for row in m)
    return [s if s < 2**63 else None for s in sums]


def whitened(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows, d = of_one_length(integers(vectors, scale, offset))
    if not d:
        return spark.createDataFrame([], RESULT)
    exact = F.sum(F.col("x").cast("decimal(20,0)"))
    sums = rows.select(F.posexplode("x").alias("pos", "x")).groupBy("pos").agg(exact.alias("s"), F.count("*").alias("n")).orderBy("pos").collect()  # d rows
    n = sums[0].n
    mean, rest = ([f(int(r.s), n) for r in sums] for f in (lambda s, n: s // n, lambda s, n: s % n))
    q, r = (F.array(*[F.lit(v).cast("long") for v in x]) for x in (mean, rest))
    away = lambda x, i: x - F.get(q, i)
    # the same doubles as in ``project``
    centred = F.transform("x", lambda x, i: F.when(F.abs(away(x, i)) < NEAR, (F.lit(n) * away(x, i) - F.get(r, i)) / F.lit(n)).otherwise(away(x, i) - F.get(r, i) / F.lit(n)))
    v = covariance(rows, centred, n, d)
    trace = float(np.trace(v))
    values, axes = components(v, min(k, d))
    real = values > RANK * max(values[0], 0.0)
    weights = np.where(real, axes / np.sqrt(np.where(real, values, 1.0)), 0.0)
    sent = spark.sparkContext.broadcast((np.array(mean), np.array(rest), n, weights))  # d by k

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, rest, n, weights = sent.value
        for f in frames:
            if not len(f):
                continue
            away = np.stack(f["x"].to_numpy()).astype(np.int64) - mean
            near = np.abs(away) < NEAR
            m = n * np.where(near, away, 0) - rest
            centred = np.where(near, m / n, away - rest / n)
            if near.all():
                deviation = squares(m)
            else:
                deviation = squares(n * away.astype(object) - rest)
            yield pd.DataFrame({"vec_id": f["vec_id"], "deviation": pd.array(deviation, "Int64"), "w": list(centred @ weights)})

    out = cut(rows.mapInPandas(project, "vec_id long, deviation long, w array<double>"))
    means = out.select(F.posexplode("w").alias("pos", "w")).groupBy("pos").agg(F.avg("w").alias("m")).orderBy("pos").collect()  # k rows
    m = F.array(*[F.lit(x.m) for x in means])
    identity = covariance(out, F.transform("w", lambda w, i: w - F.get(m, i)), n, len(means)) - np.eye(len(means))
    error = float(np.abs(identity[np.ix_(real, real)]).max(initial=0.0))
    share = F.array(*[F.lit(float(e / trace) if x else 0.0) for e, x in zip(values, real, strict=True)])
    each = out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
