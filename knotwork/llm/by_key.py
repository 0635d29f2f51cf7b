"""Joins with a table of unique keys in which a few keys may stand for a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with at least this share of all rows, and at least ``FEW`` of them, are joined by a broadcast: at most 1 / SHARE keys.
SHARE, FEW = 0.001, 1000


def joined_by_key(left: DataFrame, right: DataFrame, keys: list[str], weight: str, rows: int) -> DataFrame:
    """``left`` with the other columns of ``right``, which has each of ``keys`` once and, as ``weight``, their rows in ``left``.

    ``rows`` is the sum of all weights. The rows of heavy keys stay where they are, since what they meet is broadcast; it has at
    most 1 / SHARE rows. All others are shuffled by key. Null keys are equal to null keys. ``left`` is evaluated twice, so it
    should be a scan or a checkpoint. Keys that ``right`` lacks go.
    """
    heavy = F.col(weight) >= max(FEW, int(SHARE * rows))
    names = [f"__k{i}" for i in range(len(keys))]
    values = {f"__v{i}": c for i, c in enumerate(c for c in right.columns if c not in (*keys, weight))}
    apart = lambda x: x.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[F.col(c).alias(v) for v, c in values.items()])
    few, many = F.broadcast(apart(right.where(heavy))), apart(right.where(~heavy))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    out = [*left.columns, *[F.col(v).alias(c) for v, c in values.items()]]
    rest = left.join(few.select(*names), same, "left_anti")
    return left.join(few, same).select(*out).unionByName(rest.join(many, same).select(*out))
