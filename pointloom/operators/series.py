"""Features of ordered series given as rows, of any length and however uneven.

No series is ever held by one task: positions come from ranges of the sorted table,
everything else from aggregations that reduce before the shuffle and joins on
(series, position), which no single series can make uneven.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.staging import stage

#: Rows of a sorted range: one task's unit.
RANGE = 1_000_000


def positioned(df: DataFrame, key: str, order: Sequence[str], value: str, rows: int = RANGE, keep: Sequence[str] = ()) -> DataFrame:
    """(`key`, `pos` from 0, `v`, columns to `keep`): the rows of each series numbered by `order`; rows without a value are left out, null is a series of its own.

    The table is sorted by ranges; a row's position is that within its range and the
    rows of its series in the ranges before.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(key).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("v"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    ranges = max(1, math.ceil(known.count() / rows))
    by = ["k", *[f"o{i}" for i in range(len(order))]]
    ranged = stage(known.repartitionByRange(ranges, *by).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("k").alias("of"), F.col("part").alias("at"), F.coalesce(before, F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy("part", "k").orderBy(*by[1:])) - 1
    placed = ranged.withColumn("local", local).join(starts, F.col("k").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    return stage(placed.select(F.col("k").alias(key), (F.col("start") + F.col("local")).alias("pos"), "v", *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]), "series")


def _moments(series: DataFrame, key: str) -> DataFrame:
    """(`of`, `n`, `mean`): a row per series."""
    return series.groupBy(F.col(key).alias("of")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))


def _with(series: DataFrame, per: DataFrame, key: str) -> DataFrame:
    """The rows with what is known of their series: by Spark's own choice, so that a small table is broadcast and uneven joins are split."""
    return series.join(per, series[key].eqNullSafe(per["of"])).drop("of")


def statistics(series: DataFrame, key: str) -> DataFrame:
    """(`key`, `mean`, `std`, `min`, `max`, `range`, `skew`, `kurtosis`, `mad`): population moments; a series without spread has deviation 1 in the last three but `mad`."""
    y = F.col("v") - F.col("mean")
    powers = {f"m{p}": F.avg(F.pow(y, F.lit(float(p)))) for p in (2, 3, 4)}
    sums = _with(series, _moments(series, key), key).groupBy(key).agg(
        F.first("mean").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg(F.abs(y)).alias("mad"), *[c.alias(n) for n, c in powers.items()]
    )
    sd = F.when(F.col("m2") > 1e-12, F.sqrt("m2")).otherwise(F.lit(1.0))
    return sums.select(
        key, "mean", F.sqrt("m2").alias("std"), "min", "max", (F.col("max") - F.col("min")).alias("range"), (F.col("m3") / F.pow(sd, F.lit(3.0))).alias("skew"), (F.col("m4") / F.pow(sd, F.lit(4.0)) - 3).alias("kurtosis"), "mad"
    )


def autocorrelations(series: DataFrame, key: str, lags: Sequence[int] = (1, 2, 5, 10)) -> DataFrame:
    """(`key`, `ac<lag>` ...): products of values `lag` apart, about the series' mean, over the root of both parts' squares; 0 where there are none or no spread.

    Each row is sent to the positions it is compared with, so all lags are one shuffle.
    """
    y = _with(series, _moments(series, key), key).select(key, "pos", (F.col("v") - F.col("mean")).alias("y"), "n")
    sent = y.select(key, "y", F.explode(F.array(F.struct(F.lit(0).alias("lag"), F.col("pos").alias("to")), *[F.struct(F.lit(g).alias("lag"), (F.col("pos") + g).alias("to")) for g in lags])).alias("s"), "n").where("s.to < n")
    met = sent.groupBy(key, F.col("s.to").alias("pos")).agg(*[F.max(F.when(F.col("s.lag") == g, F.col("y"))).alias(f"y{g}") for g in (0, *lags)], F.first("n").alias("n"))
    parts = []
    for g in lags:
        there = F.col(f"y{g}").isNotNull()
        parts += [F.sum(F.when(there, F.col("y0") * F.col(f"y{g}"))).alias(f"p{g}"), F.sum(F.when(there, F.col("y0") * F.col("y0"))).alias(f"a{g}"), F.sum(F.when(there, F.col(f"y{g}") * F.col(f"y{g}"))).alias(f"b{g}")]
    sums = met.groupBy(key).agg(F.first("n").alias("n"), *parts)

    def one(g: int) -> Column:
        spread = F.sqrt(F.col(f"a{g}") / (F.col("n") - g)) * F.sqrt(F.col(f"b{g}") / (F.col("n") - g))
        return F.when((F.col("n") <= g) | F.col(f"p{g}").isNull() | (spread <= 1e-12), F.lit(0.0)).otherwise(F.col(f"p{g}") / F.sqrt(F.col(f"a{g}") * F.col(f"b{g}"))).alias(f"ac{g}")

    return sums.select(key, *[one(g) for g in lags])


def spectrum(series: DataFrame, key: str, most: int = 4) -> DataFrame:
    """(`key`, `f0` ...): magnitudes of the first Fourier coefficients after the linear trend is taken out; 0 beyond half the length."""
    per = series.groupBy(F.col(key).alias("of")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.coalesce(F.regr_slope("v", "pos"), F.lit(0.0)).alias("slope"))
    z = F.col("v") - F.col("mean") - F.col("slope") * (F.col("pos") - (F.col("n") - 1) / 2)
    turn = lambda k: F.col("pos") * (2 * math.pi * k) / F.col("n")
    sums = _with(series, per, key).groupBy(key).agg(F.first("n").alias("n"), *[f(z * g(turn(k))).alias(f"{s}{k}") for k in range(most) for s, f, g in (("c", F.sum, F.cos), ("s", F.sum, F.sin))])
    size = lambda k: F.sqrt(F.col(f"c{k}") * F.col(f"c{k}") + F.col(f"s{k}") * F.col(f"s{k}"))
    return sums.select(key, *[F.when(F.lit(k) <= F.floor(F.col("n") / 2), size(k)).otherwise(F.lit(0.0)).alias(f"f{k}") for k in range(most)])
