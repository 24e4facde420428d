"""Top N rows of every group (problem 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.staging import stage

#: Bins for scores of magnitude e as against 1 / SCALE; scores between -1 and 1 take about 2 * RESOLUTION * ln(SCALE) bins.
RESOLUTION, SCALE = 256, 1024.0
#: Groups that hold more than this fraction's inverse of all rows have a threshold of their own; so many groups at most can.
MAX_THRESHOLDS = 100_000
#: All other groups share thresholds: a group falls into one slot of each of two rows of so many.
SLOTS = 1 << 18
_NONE = -(1 << 31)


def score_bin(score: Column) -> Column:
    """A monotone integer bin of any number, fine near zero and logarithmic in the magnitude; infinities are clamped."""
    size = F.least(F.log1p(F.abs(score) * F.lit(SCALE)) * F.lit(float(RESOLUTION)), F.lit(1e6))
    return F.floor(F.signum(score) * size).cast("int")


def _shared(small: DataFrame, names: Sequence[str], row: int, slots: int) -> DataFrame:
    """(`__pl_slot`, `__pl_least`): the lowest threshold of the groups of each slot, which is safe for all of them."""
    least = small.groupBy(_slot(names, row, slots).alias(f"__pl_slot{row}")).agg(F.min(F.coalesce("__pl_floor", F.lit(_NONE))).alias(f"__pl_least{row}"))
    return least.where(F.col(f"__pl_least{row}") > _NONE)


def _slot(columns: Sequence[str], row: int, slots: int) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(row)), F.lit(slots)).cast("int")


def top_n_per_group(
    df: DataFrame, groups: Sequence[str], score: str, n: int, ties: Sequence[str], max_thresholds: int = MAX_THRESHOLDS, slots: int = SLOTS
) -> DataFrame:
    """The rows with the `n` highest scores of every group, with `rank` from 1; ties by the columns `ties`, ascending.

    A histogram of score bins per group gives every group the highest bin at and above
    which it has at least `n` rows; rows below it can't be among the best and are
    dropped before anything is shuffled. Groups with more than 1 / max_thresholds of
    all rows, fewer than `max_thresholds`, are sent their threshold. The others, of
    which there is no bound, share thresholds: each falls into a slot of each of two
    rows of `slots`, a slot holds the lowest threshold of its groups, and the higher of
    a group's two is taken. That is never above the group's own, so both broadcasts
    are bounded and the result is exact. What is left is ranked by score and ties;
    every task keeps at most `n` rows of a group before the shuffle, so that a group
    whose rows are all equal stays spread as well.

    Null and NaN scores are never ranked; 0.0 and -0.0 are equal; null is a group of
    its own; rows equal in score and ties are ordered arbitrarily among themselves
    (give a unique column last). `n` < 1 and empty tables give no rows. The result
    has the columns of `df` and `rank`, which takes the place of a column of that name.
    `df` is read twice: stage it if it is costly.
    """
    value = F.col(score).cast("double")
    valid = df.where(value.isNotNull() & ~F.isnan(value))
    clean = F.when(value == 0, F.lit(0.0)).otherwise(value)
    names = [f"__pl_g{i}" for i in range(len(groups))]
    histogram = valid.groupBy(*[F.col(g).alias(a) for g, a in zip(groups, names, strict=True)], score_bin(clean).alias("__pl_bin")).agg(F.count(F.lit(1)).alias("__pl_rows"))
    down = Window.partitionBy(*names).orderBy(F.desc("__pl_bin"))
    floors = stage(
        histogram.withColumn("__pl_above", F.sum("__pl_rows").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*names)
        .agg(F.max(F.when(F.col("__pl_above") >= n, F.col("__pl_bin"))).alias("__pl_floor"), F.sum("__pl_rows").alias("__pl_size")),
        "floors",
    )
    total = floors.agg(F.sum("__pl_size")).first()[0] or 0
    large = F.col("__pl_size") > total / max_thresholds
    own = floors.where(F.col("__pl_floor").isNotNull() & large).drop("__pl_size")
    same = None
    for g, a in zip(groups, names, strict=True):
        test = F.col(g).eqNullSafe(F.col(a))
        same = test if same is None else same & test
    above = valid.join(F.broadcast(own), same, "left")
    bound = F.col("__pl_floor")
    small = floors.where(~large)
    if not small.isEmpty():
        for row in (0, 1):
            above = above.withColumn(f"__pl_at{row}", _slot(groups, row, slots))
            above = above.join(F.broadcast(_shared(small, names, row, slots)), F.col(f"__pl_at{row}") == F.col(f"__pl_slot{row}"), "left")
        bound = F.coalesce(bound, F.greatest("__pl_least0", "__pl_least1"))
    above = above.where(bound.isNull() | (score_bin(clean) >= bound))
    order = Window.partitionBy(*groups).orderBy(F.desc(clean), *[F.asc(t) for t in ties])
    return above.select(*df.columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
