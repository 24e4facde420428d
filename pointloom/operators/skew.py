"""Joins against a table with one row a key, when a key may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys can each hold more than this fraction's inverse of all rows.
HOT_KEYS = 10_000


def join_by_weight(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], weight: str, total: int, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of `rows` with `keyed` (one row a key; `weight`: the key's number of rows) on null-safe `keys`.

    Keys with more than total / hot_keys rows number less than `hot_keys`, whatever
    the data, and are broadcast; their rows are never shuffled. The other keys hold
    at most that many rows each and go through an ordinary shuffle join. `weight` is
    kept. With `total` 0 the result is empty.
    """
    cut = max(1.0, total / hot_keys)
    extra = [c for c in keyed.columns if c not in keys]
    side = keyed.select(*[F.col(k).alias(f"__pl_k{i}") for i, k in enumerate(keys)], *extra)
    on = None
    for i, k in enumerate(keys):
        test = F.col(k).eqNullSafe(F.col(f"__pl_k{i}"))
        on = test if on is None else on & test
    drop = [f"__pl_k{i}" for i in range(len(keys))]
    hot = side.where(F.col(weight) > cut)
    cold = side.where(F.col(weight) <= cut)
    marks = hot.select(*drop).withColumn("__pl_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot.withColumn("__pl_hot", F.lit(True))), on, "left")
    warm = marked.where(F.col("__pl_hot")).drop("__pl_hot", *drop)
    rest = rows.join(F.broadcast(marks), on, "left_anti").join(cold, on, "inner").drop(*drop)
    return warm.select(*rows.columns, *extra).unionByName(rest.select(*rows.columns, *extra))
