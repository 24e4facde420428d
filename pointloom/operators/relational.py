"""Relational operators over results and trajectories."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def flatten(df: DataFrame, struct: str, protected: Sequence[str]) -> DataFrame:
    """The fields of `struct` as columns; a field that is protected and exists already becomes `metric_<name>`."""
    own = [c for c in df.columns if c != struct]
    fields = [f.name for f in df.schema[struct].dataType.fields]
    return df.select(*own, *[F.col(f"{struct}.{f}").alias(f"metric_{f}" if f in protected and f in own else f) for f in fields])


def equal_filters(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that equal every given value; None asks for nothing."""
    return reduce(lambda d, kv: d if kv[1] is None else d.where(F.col(kv[0]) == F.lit(kv[1])), wanted.items(), df)


def leaderboard(df: DataFrame, metric: str, tie: str, limit: int = 200, missing: float = -1.0, **wanted: object) -> DataFrame:
    """The `limit` best rows by `metric`, missing ones as `missing`; ties by `tie`."""
    return equal_filters(df, **wanted).orderBy(F.coalesce(metric, F.lit(missing)).desc(), F.asc(tie)).limit(limit)


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str, kind: str = "double") -> DataFrame:
    """One row per key and column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in columns]))
    return df.select(*keys, pairs.alias("__pl_u")).select(*keys, f"__pl_u.{name}", f"__pl_u.{value}")


def mean_by_property(df: DataFrame, algo: str, properties: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric for each algorithm and value of each property: one aggregation over both unpivoted."""
    xs = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("double").alias("x")) for p in properties])).alias("p")
    means = [F.avg(m).alias(m) for m in metrics]
    wide = df.select(algo, *metrics, xs).where("p.x is not null").groupBy(algo, F.col("p.property").alias("property"), F.col("p.x").alias("x")).agg(*means)
    return unpivot(wide, [algo, "property", "x"], metrics, "metric", "mean").where("mean is not null")


def task_ranks(df: DataFrame, metric: str, tasks: Sequence[str], higher: bool = True) -> DataFrame:
    """`rank` of each row within its task, the mean rank for ties; rows without the metric are left out. Null is a value of a task key."""
    score = F.col(metric).cast("double")
    by = Window.partitionBy(*tasks)
    order = by.orderBy(score.desc() if higher else score.asc())
    same = Window.partitionBy(*tasks, score)
    known = df.where(score.isNotNull() & ~F.isnan(score))
    return known.withColumn("rank", F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0))


def average_ranks(df: DataFrame, metric: str, tasks: Sequence[str], algo: str = "algo", higher: bool = True) -> DataFrame:
    """Mean rank of each algorithm over all the tasks it has."""
    return task_ranks(df, metric, tasks, higher).groupBy(algo).agg(F.avg("rank").alias("avg_rank"), F.count(F.lit(1)).alias("n_tasks"))


def complete_tasks(df: DataFrame, metric: str, tasks: Sequence[str], algo: str = "algo") -> DataFrame:
    """One row per task and algorithm (the first by the other columns), of tasks that have the metric for every algorithm of `df`."""
    score = F.col(metric).cast("double")
    cells = df.groupBy(*tasks, algo).agg(F.max(score).alias(metric)).where(F.col(metric).isNotNull() & ~F.isnan(metric))
    count = df.agg(F.countDistinct(algo)).first()[0]
    full = cells.withColumn("__pl_n", F.count(F.lit(1)).over(Window.partitionBy(*tasks)))
    return full.where(F.col("__pl_n") == count).drop("__pl_n")


def friedman(df: DataFrame, metric: str, tasks: Sequence[str], algo: str = "algo", higher: bool = True, ties: bool = True) -> DataFrame:
    """One row (`n`, `k`, `statistic`): Friedman's chi-square over complete tasks, corrected for ties or not; null statistic without complete tasks or with less than three algorithms."""
    ranked = task_ranks(complete_tasks(df, metric, tasks, algo), metric, tasks, higher)
    tied = ranked.groupBy(*tasks, metric).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    sums = ranked.groupBy(algo).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    whole = sums.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * F.col("r")).alias("ss"))
    both = whole.join(F.broadcast(tied))  # two single rows
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    plain = 12.0 / (n * k * (k + 1)) * F.col("ss") - 3.0 * n * (k + 1)
    fix = (1.0 - F.col("ties") / (n * k * (k * k - 1))) if ties else F.lit(1.0)
    return both.select("n", "k", F.when((n > 0) & (k >= 3) & (fix > 0), plain / fix).alias("statistic"))


def chi_square_survival(statistic: float, df: int) -> float:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function by series or continued fraction."""
    a, x = df / 2.0, statistic / 2.0
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        for i in range(1, 10_000):
            term *= x / (a + i)
            total += term
            if term < total * 1e-16:
                break
        return 1.0 - front * total
    b, c = x + 1.0 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def with_chi_square_p(df: DataFrame, statistic: str, freedom: str, out: str = "p") -> DataFrame:
    """Add the upper tail probability of each row's statistic, a batch at a time; null for null."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def add(frames):
        for frame in frames:
            p = [None if s is None or s != s else chi_square_survival(s, int(d)) for s, d in zip(frame[statistic], frame[freedom], strict=True)]
            yield frame.assign(**{out: p})

    return df.mapInPandas(add, f"{fields}, `{out}` double")


def detailed_ranks(df: DataFrame, metric: str, tasks: Sequence[str], algo: str = "algo", higher: bool = True, condition: Sequence[str] = ()) -> DataFrame:
    """Mean rank, wins (ties for best count), mean metric and tasks of each algorithm, within each `condition`."""
    keys = [*condition, *[t for t in tasks if t not in condition]]
    ranked = task_ranks(df, metric, keys, higher)
    best = F.max(metric) if higher else F.min(metric)
    won = F.col(metric) == best.over(Window.partitionBy(*keys))
    return (
        ranked.withColumn("won", won.cast("int"))
        .groupBy(*condition, algo)
        .agg(F.avg("rank").alias("avg_rank"), F.sum("won").alias("wins"), F.avg(metric).alias("mean_metric"), F.count(F.lit(1)).alias("n_tasks"))
    )


def best_by_condition(df: DataFrame, metric: str, tasks: Sequence[str], condition: str, algo: str = "algo", higher: bool = True) -> DataFrame:
    """Best and second algorithm of each value of `condition`, by mean rank, then wins, then name."""
    order = Window.partitionBy(condition).orderBy("avg_rank", F.desc("wins"), algo)
    placed = detailed_ranks(df, metric, tasks, algo, higher, [condition]).withColumn("place", F.row_number().over(order)).where("place <= 2")
    pick = lambda p, c: F.max(F.when(F.col("place") == p, F.col(c)))
    return placed.groupBy(condition).agg(
        pick(1, algo).alias("best"), pick(1, "avg_rank").alias("best_rank"), pick(2, algo).alias("runner_up"), pick(2, "avg_rank").alias("runner_up_rank"), F.max("n_tasks").alias("n_tasks")
    )


def metric_rank_order(df: DataFrame, metrics: Mapping[str, bool], algo: str = "algo") -> DataFrame:
    """Algorithms by the mean of their ranks per metric (True: higher is better), where ranks are of their mean metric."""
    means = df.groupBy(algo).agg(*[F.avg(m).alias(m) for m in metrics])
    signed = means.select(algo, *[(F.col(m) if up else -F.col(m)).alias(m) for m, up in metrics.items()])
    long = unpivot(signed, [algo], list(metrics), "metric", "value").where("value is not null")
    return task_ranks(long, "value", ["metric"]).groupBy(algo).agg(F.avg("rank").alias("mean_rank"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by `order`, taken by a partial aggregation rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    lead = [F.col(c) for c in order]
    packed = F.min(F.struct(*[c.alias(f"__pl_o{i}") for i, c in enumerate(lead)], *[F.col(c) for c in rest])).alias("__pl_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"__pl_row.{c}").alias(c) for c in rest]).select(*df.columns)


def last_wins_map(df: DataFrame, keys: Sequence[str], name: str, value: str, order: str) -> DataFrame:
    """keys -> map of name to the value of the last row by `order`; missing values are skipped."""
    v = F.col(value).cast("double")
    last = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, name).agg(F.max_by(v, order).alias("__pl_v"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(name), F.col("__pl_v"))))
    return last.groupBy(*keys).agg(F.map_from_entries(entries).alias("by_name"))


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`existing` with the rows whose keys occur in `new` replaced by those of `new`; null keys equal null, missing columns are null."""
    fresh = new.select(*[F.col(k).alias(f"__pl_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__pl_{k}")) for k in keys])
    return existing.join(fresh, same, "left_anti").unionByName(new, allowMissingColumns=True)


def expand_grid(spark, axes: Mapping[str, Sequence]) -> DataFrame:
    """The product of `axes`, the last one running fastest, with its `row_number` from 0.

    A row of the product is computed from its number, so the product is one range
    that any number of tasks can generate, not a chain of joins.
    """
    size = math.prod(len(v) for v in axes.values())
    df = spark.range(size).withColumnRenamed("id", "row_number")
    step = size
    for name, values in axes.items():
        step //= max(1, len(values))
        at = (F.floor(F.col("row_number") / step) % len(values)).cast("int")
        df = df.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in values]), at + 1))
    return df


def strided(df: DataFrame, number: str, total: int, most: int) -> DataFrame:
    """Every (total // most)-th row by `number`, at most `most`."""
    stride = max(1, total // most)
    return df.where((F.col(number) % stride == 0) & (F.col(number) < stride * most))


def nearest(queries: DataFrame, targets: DataFrame, features: Sequence[str], query: str, target: str, scales: Mapping[str, float] | None = None, max_targets: int = 200_000) -> DataFrame:
    """(`query`, `target`, `distance`): the nearest target of each query by scaled Euclidean distance, the smallest `target` of equals.

    The targets are a table of known tasks. Up to `max_targets` of them are packed
    into one broadcast array that each query searches; more are packed in blocks and
    the best of each block compared, so no pair is ever a row.
    """
    scale = {f: 1.0 for f in features} | dict(scales or {})
    point = lambda: F.array(*[F.col(f).cast("double") / F.lit(float(scale[f])) for f in features])
    blocks = max(1, math.ceil(targets.count() / max_targets))
    packed = targets.select(F.struct(point().alias("x"), F.col(target).alias("t")).alias("__pl_p"), F.pmod(F.xxhash64(target), F.lit(blocks)).alias("__pl_b"))
    packed = packed.groupBy("__pl_b").agg(F.collect_list("__pl_p").alias("__pl_ps"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asked = queries.select(F.col(query).alias("__pl_id"), point().alias("__pl_q")).withColumn("__pl_b", every)
    d = lambda p: F.sqrt(F.aggregate(F.zip_with(p["x"], F.col("__pl_q"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    best = F.array_min(F.transform("__pl_ps", lambda p: F.struct(F.round(d(p), 9).alias("distance"), p["t"].alias("t"))))
    joined = asked.join(F.broadcast(packed) if blocks == 1 else packed, "__pl_b").select("__pl_id", best.alias("m"))
    return joined.groupBy("__pl_id").agg(F.min("m").alias("m")).select(F.col("__pl_id").alias(query), F.col("m.t").alias(target), F.col("m.distance").alias("distance"))


def upper_median(column: str) -> Column:
    """The upper of the two middle values (nulls aside)."""
    return -F.expr(f"percentile_disc(0.5) within group (order by -`{column}`)")


def discounted_to_go(df: DataFrame, keys: Sequence[str], order: str, reward: str, gamma: float) -> DataFrame:
    """`return_to_go`: reward plus gamma times that of the next step, backwards within each key.

    A fold over the rows of a task in reverse order with one return carried, so an
    episode of any length takes no more memory than a batch.
    """
    columns = df.columns
    of, value = [columns.index(k) for k in keys], columns.index(reward)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ahead = None, None
        for batch in batches:
            held = batch.columns
            names = zip(*[held[i].to_pylist() for i in of], strict=True)
            out = []
            for key, r in zip(names, held[value].to_pylist(), strict=True):
                if key != last:
                    last, ahead = key, None
                if ahead is not None:
                    ahead = gamma * ahead + (r or 0.0)
                elif r is not None:
                    ahead = float(r)
                out.append(ahead)
            yield pa.RecordBatch.from_arrays([*held, pa.array(out, pa.float64())], names=[*columns, "return_to_go"])

    back = df.repartition(*keys).sortWithinPartitions(*keys, F.desc(order))
    return back.mapInArrow(fold, StructType([*df.schema.fields, StructField("return_to_go", DoubleType())]))


def group_split(df: DataFrame, group: str, share: float, seed: int = 0) -> DataFrame:
    """`held_out`: whether the row's group is in the held-out share; groups are placed by a hash of group and seed."""
    digest = F.md5(F.concat_ws("|", F.col(group).cast("string"), F.lit(str(seed))))
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(10_000))
    return df.withColumn("held_out", bucket < round(share * 10_000))


def zscores(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """`columns` less their mean over their population deviation, which is 1 where it is 0; a single pass gives all."""
    stats = df.groupBy(*by).agg(*[f(c).alias(f"__pl_{s}_{c}") for c in columns for s, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.join(F.broadcast(stats)) if not by else df.join(stats, list(by))
    z = {c: (F.col(c) - F.col(f"__pl_m_{c}")) / F.when(F.col(f"__pl_s_{c}") > 0, F.col(f"__pl_s_{c}")).otherwise(1.0) for c in columns}
    return joined.withColumns(z).select(*df.columns)


def min_max(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """`out`: value scaled to 0..1 within `by`; 1 where the range is below 1e-12, null for null and NaN."""
    w = Window.partitionBy(*by)
    v = F.when(~F.isnan(value), F.col(value))
    lo, hi = F.min(v).over(w), F.max(v).over(w)
    return df.withColumn(out, F.when(v.isNull(), None).when(hi - lo < 1e-12, F.lit(1.0)).otherwise((v - lo) / (hi - lo)))


def weighted_mean(value: str, weight: str) -> Column:
    """Mean over what is known: weights of missing values are left out."""
    known = F.col(value).isNotNull()
    return F.sum(F.when(known, F.col(value) * F.col(weight))) / F.sum(F.when(known, F.col(weight)))
