"""Queries over results, trajectories, errors and cards, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.operators import relational as R
from pointloom.plans.base import METRICS, RUNS_SQL, TASK, clean, finite_sql, runs
from pointloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def even(c, digits: int):
    """Rounded for comparison: what lies on the border between two values, but for the order of a sum, always goes up."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-10, digits)


_TASK = ", ".join(TASK)
#: A complete table: mean metrics of each algorithm on each dataset.
_CELLS_SQL = f"""{RUNS_SQL}, cells AS (
  SELECT dataset, algo, round(avg(ari), 9) AS ari, round(avg(wall_time_s), 9) AS wall_time_s, round(avg(nmi), 9) AS nmi FROM runs GROUP BY dataset, algo
)"""


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    df = runs(spark, folder, "dataset", "ari", "wall_time_s", "nmi")
    return df.groupBy("dataset", "algo").agg(*[F.round(F.avg(m), 9).alias(m) for m in ("ari", "wall_time_s", "nmi")])


@query("SELECT result_id, algo, compactness, " + ", ".join(f"{finite_sql(m)} AS {m}" for m in ("ari", "nmi", "metric_compactness")) + " FROM results")
def results_flatten(spark, folder):
    """Nested metrics as columns, NaN and infinities as null; the one that clashes with a task column is renamed."""
    df = clean(table(spark, folder, "results"), ["ari", "nmi", "metric_compactness"])
    nested = df.select("result_id", "algo", "compactness", F.struct("ari", "nmi", F.col("metric_compactness").alias("compactness")).alias("metrics"))
    return R.flatten(nested, "metrics", ["compactness"])


@query("SELECT result_id, algo, n_samples, " + ", ".join(f"{finite_sql(m)} AS {m}" for m in METRICS) + " FROM results")
def results_clean(spark, folder):
    """The exported columns with NaN and infinities as null."""
    return clean(table(spark, folder, "results"), list(METRICS)).select("result_id", "algo", "n_samples", *METRICS)


@query("SELECT result_id, TRY_CAST(json_extract_string(extra, '$.n_iter') AS DOUBLE) AS n_iter, TRY_CAST(extra AS DOUBLE) AS whole FROM results")
def cast_coerce(spark, folder):
    """Numbers out of free text; what is none becomes null."""
    df = table(spark, folder, "results")
    return df.select("result_id", F.get_json_object("extra", "$.n_iter").try_cast("double").alias("n_iter"), F.col("extra").try_cast("double").alias("whole"))


@query(f"{RUNS_SQL} SELECT result_id, algo, dataset, ari FROM runs WHERE algo = 'kmeans' AND compactness = 1.0 ORDER BY coalesce(ari, -1) DESC, result_id LIMIT 200")
def leaderboard(spark, folder):
    """The 200 best runs of an algorithm at one compactness."""
    df = runs(spark, folder, "dataset", "ari", "compactness", "seed")
    return R.leaderboard(df, "ari", "result_id", 200, algo="kmeans", compactness=1.0, seed=None).select("result_id", "algo", "dataset", "ari")


@query(f"SELECT DISTINCT run_id, step_idx, round({finite_sql('cost')}, 9) AS cost FROM step_records WHERE algo = 'kmeans' AND compactness = 1.0 ORDER BY run_id, step_idx, cost NULLS FIRST LIMIT 20")
def trajectory_viewer(spark, folder):
    """The first 20 steps shown for an algorithm and compactness; an unknown cost is null."""
    df = clean(R.equal_filters(table(spark, folder, "step_records"), algo="kmeans", compactness=1.0, dataset_id=None), ["cost"])
    return df.select("run_id", "step_idx", F.round("cost", 9).alias("cost")).distinct().orderBy("run_id", "step_idx", "cost").limit(20)


@query(f"""{RUNS_SQL} SELECT count(DISTINCT algo) AS n_algos, (SELECT count(*) FROM (SELECT DISTINCT {_TASK} FROM runs)) AS n_tasks,
count(*) AS n_rows, round(avg(ari) + 1e-10, 6) AS mean_ari, round(avg(wall_time_s) + 1e-10, 6) AS mean_wall FROM runs""")
def global_aggregates(spark, folder):
    """Numbers of algorithms, tasks and rows, mean score and mean time."""
    df = runs(spark, folder, *TASK, "ari", "wall_time_s").withColumn("task", F.struct(*TASK))
    return df.agg(F.countDistinct("algo").alias("n_algos"), F.countDistinct("task").alias("n_tasks"), F.count(F.lit(1)).alias("n_rows"), even(F.avg("ari"), 6).alias("mean_ari"), even(F.avg("wall_time_s"), 6).alias("mean_wall"))


_FOUR = ("ari", "nmi", "silhouette", "wall_time_s")


@query(f"{RUNS_SQL} SELECT algo, " + ", ".join(f"round(coalesce(avg({m}), 0) + 1e-10, 6) AS {m}" for m in _FOUR) + " FROM runs GROUP BY algo")
def algo_means(spark, folder):
    """Four mean metrics per algorithm, 0 where none is known."""
    return runs(spark, folder, *_FOUR).groupBy("algo").agg(*[even(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in _FOUR])


_PROPERTIES = ("n_samples", "n_features", "k_target", "compactness", "outliers", "noise", "density")
_EIGHT = ("ari", "nmi", "silhouette", "davies_bouldin", "dunn", "separation", "wall_time_s", "rss_delta_mb")


@query(f"""{RUNS_SQL}, long AS (
  {" UNION ALL ".join(f"SELECT algo, '{p}' AS property, CAST({p} AS DOUBLE) AS x, {', '.join(_EIGHT)} FROM runs" for p in _PROPERTIES)}
), means AS (SELECT algo, property, x, {", ".join(f"avg({m}) AS {m}" for m in _EIGHT)} FROM long WHERE x IS NOT NULL GROUP BY algo, property, x)
SELECT algo, property, x, metric, round(mean + 1e-10, 6) AS mean FROM (
  {" UNION ALL ".join(f"SELECT algo, property, x, '{m}' AS metric, {m} AS mean FROM means" for m in _EIGHT)}
) WHERE mean IS NOT NULL""")
def mean_by_property(spark, folder):
    """Eight metrics against seven properties for every algorithm."""
    df = runs(spark, folder, *_PROPERTIES, *_EIGHT)
    return R.mean_by_property(df, "algo", _PROPERTIES, _EIGHT).withColumn("mean", even("mean", 6))


_RANKED = """ranked AS (SELECT *, rank() OVER (PARTITION BY {t} ORDER BY {m} {d}) + (count(*) OVER (PARTITION BY {t}, {m}) - 1) / 2.0::DOUBLE AS r FROM {f} WHERE {m} IS NOT NULL)"""


@query(f"{RUNS_SQL}, {_RANKED.format(t=_TASK, m='ari', d='DESC', f='runs')} SELECT algo, round(avg(r) + 1e-10, 6) AS avg_rank, count(*) AS n_tasks FROM ranked GROUP BY algo")
def average_ranks(spark, folder):
    """Mean rank of each algorithm over all tasks by score."""
    return R.average_ranks(runs(spark, folder, *TASK, "ari"), "ari", TASK).withColumn("avg_rank", even("avg_rank", 6))


@query(f"{RUNS_SQL}, {_RANKED.format(t=_TASK, m='wall_time_s', d='ASC', f='runs')} SELECT algo, round(avg(r) + 1e-10, 6) AS avg_rank, count(*) AS n_tasks FROM ranked GROUP BY algo")
def average_ranks_time(spark, folder):
    """Mean rank of each algorithm over all tasks by time, less being better."""
    return R.average_ranks(runs(spark, folder, *TASK, "wall_time_s"), "wall_time_s", TASK, higher=False).withColumn("avg_rank", even("avg_rank", 6))


_FULL = """full_cells AS (SELECT * FROM cells WHERE {m} IS NOT NULL AND dataset IN (SELECT dataset FROM cells WHERE {m} IS NOT NULL GROUP BY dataset HAVING count(*) = (SELECT count(DISTINCT algo) FROM cells)))"""
_CHI = """sums AS (SELECT algo, sum(r) AS r, count(*) AS n FROM ranked GROUP BY algo), tied AS (SELECT sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT count(*) AS t FROM ranked GROUP BY dataset, {m})),
whole AS (SELECT coalesce(max(n), 0) AS n, count(*) AS k, sum(r * r) AS ss FROM sums)
SELECT n, k, round((12.0::DOUBLE / (n * k * (k + 1)) * ss - 3.0::DOUBLE * n * (k + 1)) / {fix} + 1e-10, 6) AS statistic FROM whole, tied"""


def _chi(m: str, d: str, fix: bool) -> str:
    f = "(1.0::DOUBLE - ties / (n::DOUBLE * k * (k * k - 1)))" if fix else "1.0::DOUBLE"
    return f"{_CELLS_SQL}, {_FULL.format(m=m)}, {_RANKED.format(t='dataset', m=m, d=d, f='full_cells')}, {_CHI.format(m=m, fix=f)}"


@query(_chi("ari", "DESC", True))
def friedman_stat(spark, folder):
    """Friedman's statistic of the score over datasets on which every algorithm ran."""
    return R.friedman(_cells(spark, folder), "ari", ["dataset"]).withColumn("statistic", even("statistic", 6))


@query(_chi("wall_time_s", "ASC", False))
def rank_test(spark, folder):
    """The same statistic of the time without correction for ties."""
    return R.friedman(_cells(spark, folder), "wall_time_s", ["dataset"], higher=False, ties=False).withColumn("statistic", even("statistic", 6))


#: Upper tail of the chi-square distribution by the series of the incomplete gamma function.
_TAIL_SQL = _chi("ari", "DESC", True).replace("WITH latest", "WITH RECURSIVE latest", 1).replace("FROM sums)\nSELECT n, k,", "FROM sums), stat AS (SELECT n, k,", 1)
_TAIL_SQL += """), half AS (SELECT (k - 1) / 2.0::DOUBLE AS a, statistic / 2 AS x FROM stat),
series(i, term, total) AS (SELECT 0, 1 / a, 1 / a FROM half UNION ALL SELECT i + 1, term * x / (a + i + 1), total + term * x / (a + i + 1) FROM series, half WHERE i < 2000)
SELECT n, k, statistic, k - 1 AS freedom, CASE WHEN statistic IS NOT NULL THEN round(greatest(0, 1 - exp(-x + a * ln(x) - lgamma(a)) * total) + 1e-10, 6) END AS p FROM stat, half, series WHERE i = 2000"""


@query(_TAIL_SQL)
def friedman_test(spark, folder):
    """Friedman's statistic with its p-value."""
    tested = R.friedman(_cells(spark, folder), "ari", ["dataset"]).withColumn("freedom", F.col("k") - 1)
    return R.with_chi_square_p(tested, "statistic", "freedom").withColumns({"statistic": even("statistic", 6), "p": even("p", 6)})


@query(f"""{RUNS_SQL}, {_RANKED.format(t=_TASK, m='ari', d='DESC', f='runs')}, won AS (SELECT *, (ari = max(ari) OVER (PARTITION BY {_TASK}))::INT AS w FROM ranked)
SELECT algo, round(avg(r) + 1e-10, 6) AS avg_rank, sum(w)::BIGINT AS wins, round(avg(ari) + 1e-10, 6) AS mean_metric, count(*) AS n_tasks FROM won GROUP BY algo""")
def detailed_ranks(spark, folder):
    """Mean rank, wins and mean score of each algorithm."""
    df = R.detailed_ranks(runs(spark, folder, *TASK, "ari"), "ari", TASK)
    return df.withColumns({"avg_rank": even("avg_rank", 6), "mean_metric": even("mean_metric", 6)})


@query(f"""{RUNS_SQL}, {_RANKED.format(t=_TASK, m='ari', d='DESC', f='runs')}, won AS (SELECT *, (ari = max(ari) OVER (PARTITION BY {_TASK}))::INT AS w FROM ranked),
agg AS (SELECT dataset, algo, avg(r) AS avg_rank, sum(w) AS wins, count(*) AS n FROM won GROUP BY dataset, algo),
placed AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY avg_rank, wins DESC, algo) AS place FROM agg)
SELECT dataset, max(CASE WHEN place = 1 THEN algo END) AS best, round(max(CASE WHEN place = 1 THEN avg_rank END) + 1e-10, 6) AS best_rank, max(CASE WHEN place = 2 THEN algo END) AS runner_up,
round(max(CASE WHEN place = 2 THEN avg_rank END) + 1e-10, 6) AS runner_up_rank, max(n) AS n_tasks FROM placed WHERE place <= 2 GROUP BY dataset""")
def best_by_condition(spark, folder):
    """Best and second algorithm on each dataset."""
    df = R.best_by_condition(runs(spark, folder, *TASK, "ari"), "ari", TASK, "dataset")
    return df.withColumns({c: even(c, 6) for c in ("best_rank", "runner_up_rank")})


_DIRECTIONS = {"ari": True, "nmi": True, "silhouette": True, "davies_bouldin": False, "wall_time_s": False}


@query(f"""{RUNS_SQL}, means AS (SELECT algo, {", ".join(f"round({'' if up else '-'}avg({m}), 9) AS {m}" for m, up in _DIRECTIONS.items())} FROM runs GROUP BY algo),
long AS ({" UNION ALL ".join(f"SELECT algo, '{m}' AS metric, {m} AS v FROM means WHERE {m} IS NOT NULL" for m in _DIRECTIONS)}),
ranked AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY v DESC) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0::DOUBLE AS r FROM long)
SELECT algo, round(avg(r) + 1e-10, 6) AS mean_rank FROM ranked GROUP BY algo""")
def metric_rank_order(spark, folder):
    """Algorithms by the mean of their ranks in five metrics."""
    return R.metric_rank_order(runs(spark, folder, *_DIRECTIONS), _DIRECTIONS).withColumn("mean_rank", even("mean_rank", 6))


@query(f"{RUNS_SQL} SELECT DISTINCT {_TASK} FROM runs")
def distinct_tasks(spark, folder):
    """All tasks."""
    return runs(spark, folder, *TASK).select(*TASK).distinct()


@query(f"{RUNS_SQL} SELECT result_id, dataset, n_samples, seed FROM (SELECT *, row_number() OVER (PARTITION BY dataset, n_samples, seed ORDER BY result_id) AS t FROM runs) WHERE t = 1")
def keep_first_task(spark, folder):
    """The first run of each dataset, size and seed."""
    df = runs(spark, folder, "dataset", "n_samples", "seed").select("result_id", "dataset", "n_samples", "seed")
    return R.keep_first(df, ["dataset", "n_samples", "seed"], ["result_id"])


@query(f"""{RUNS_SQL}, last AS (SELECT dataset, seed, algo, arg_max(ari, result_id) AS ari FROM runs WHERE ari IS NOT NULL GROUP BY dataset, seed, algo)
SELECT dataset, seed, count(*) AS n_algos, round(sum(ari) + 1e-10, 6) AS total, max(CASE WHEN algo = 'kmeans' THEN ari END) AS kmeans FROM last GROUP BY dataset, seed""")
def task_algo_map(spark, folder):
    """Scores by algorithm of each dataset and seed, the last run's winning, read from the map."""
    df = R.last_wins_map(runs(spark, folder, "dataset", "seed", "ari"), ["dataset", "seed"], "algo", "ari", "result_id")
    values = F.map_values("by_name")
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return df.select("dataset", "seed", F.size("by_name").cast("long").alias("n_algos"), even(total, 6).alias("total"), F.element_at("by_name", "kmeans").alias("kmeans"))


@query(f"""{RUNS_SQL}, old AS (SELECT algo, dataset, seed, k_target, max(result_id) AS result_id FROM runs WHERE seed <= 20 GROUP BY ALL),
new AS (SELECT algo, dataset, seed, k_target, max(result_id) + 1000000 AS result_id FROM runs WHERE seed >= 10 GROUP BY ALL)
SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.algo = o.algo AND n.dataset IS NOT DISTINCT FROM o.dataset AND n.seed = o.seed AND n.k_target IS NOT DISTINCT FROM o.k_target) UNION ALL SELECT * FROM new""")
def results_upsert(spark, folder):
    """A delivery of the seeds from 10 on merged into the table of those up to 20."""
    keys = ["algo", "dataset", "seed", "k_target"]
    df = runs(spark, folder, "dataset", "seed", "k_target")
    old = df.where("seed <= 20").groupBy(*keys).agg(F.max("result_id").alias("result_id"))
    new = df.where("seed >= 10").groupBy(*keys).agg((F.max("result_id") + 1_000_000).alias("result_id"))
    return R.upsert(old, new, keys)


_AXES = {"n_samples": [200, 500, 1000, 2000], "k": [2, 3, 5, 8], "compactness": [0.3, 0.5, 1.0, 1.5], "outliers": [0, 20, 80], "seed": [1, 2, 3]}
_AXES_SQL = " CROSS JOIN ".join(f"(SELECT unnest({v}) AS {k}, unnest(range({len(v)})) AS i_{k})" for k, v in _AXES.items())
_NUMBER = "((((i_n_samples * 4 + i_k) * 4 + i_compactness) * 3 + i_outliers) * 3 + i_seed)"


@query(f"SELECT {_NUMBER} AS row_number, n_samples, k, compactness::DOUBLE AS compactness, outliers, seed FROM {_AXES_SQL}")
def grid_expand(spark, folder):
    """All tasks of a grid of five axes."""
    return R.expand_grid(spark, _AXES)


@query(f"SELECT * FROM (SELECT {_NUMBER} AS row_number, n_samples, k, compactness::DOUBLE AS compactness, outliers, seed FROM {_AXES_SQL}) WHERE row_number % 5 = 0 AND row_number < 500")
def grid_stride_sample(spark, folder):
    """A hundred tasks of the grid at even strides."""
    return R.strided(R.expand_grid(spark, _AXES), "row_number", 576, 100)


@query(f"{RUNS_SQL} SELECT r.result_id, r.algo, c.family, c.handles_k_directly FROM runs r LEFT JOIN cards c ON r.algo = c.name")
def cards_lookup(spark, folder):
    """The card of each run's algorithm; null where there is none."""
    cards = table(spark, folder, "cards").select(F.col("name").alias("algo"), "family", "handles_k_directly")
    return runs(spark, folder).join(cards, "algo", "left").select("result_id", "algo", "family", "handles_k_directly")


@query(f"""{RUNS_SQL}, known AS (SELECT DISTINCT n_samples, n_features, coalesce(k_target, 0) AS k FROM runs), t AS (SELECT *, n_samples::BIGINT * 1000000 + n_features * 1000 + k AS id FROM known),
q AS (SELECT row_number() OVER (ORDER BY name) AS qid, name, n_samples, n_features, n_classes FROM dataset_metadata),
d AS (SELECT q.name, t.id, round(sqrt(pow((q.n_samples - t.n_samples) / 1000.0::DOUBLE, 2) + pow((q.n_features - t.n_features) / 16.0::DOUBLE, 2) + pow((q.n_classes - t.k) / 4.0::DOUBLE, 2)), 9) AS distance FROM q, t)
SELECT name, arg_min(id, (distance, id)) AS id, min(distance) AS distance FROM d GROUP BY name""")
def nearest_task(spark, folder):
    """The known task nearest to each listed dataset."""
    t = runs(spark, folder, "n_samples", "n_features", "k_target").select("n_samples", "n_features", F.coalesce("k_target", F.lit(0)).alias("k")).distinct()
    t = t.withColumn("id", F.col("n_samples").cast("long") * 1_000_000 + F.col("n_features") * 1000 + F.col("k"))
    q = table(spark, folder, "dataset_metadata").select("name", "n_samples", "n_features", F.col("n_classes").alias("k"))
    return R.nearest(q, t, ["n_samples", "n_features", "k"], "name", "id", {"n_samples": 1000.0, "n_features": 16.0, "k": 4.0})


@query(f"{RUNS_SQL} SELECT algo, result_id, ari FROM (SELECT *, row_number() OVER (PARTITION BY algo ORDER BY ari DESC, result_id) AS t FROM runs WHERE ari IS NOT NULL) WHERE t <= 3")
def top_k_per_algo(spark, folder):
    """The three best runs of each algorithm."""
    w = Window.partitionBy("algo").orderBy(F.desc("ari"), "result_id")
    return runs(spark, folder, "ari").where("ari is not null").withColumn("t", F.row_number().over(w)).where("t <= 3").select("algo", "result_id", "ari")


@query(f"""{RUNS_SQL} SELECT algo, list_sort(list(wall_time_s))[count(wall_time_s) // 2 + 1] AS upper, round(median(wall_time_s), 9) AS middle, round(avg(wall_time_s) + 1e-10, 6) AS mean FROM runs WHERE wall_time_s IS NOT NULL GROUP BY algo""")
def group_medians(spark, folder):
    """Upper median, median and mean time of each algorithm."""
    df = runs(spark, folder, "wall_time_s").where("wall_time_s is not null")
    return df.groupBy("algo").agg(R.upper_median("wall_time_s").alias("upper"), F.round(F.median("wall_time_s"), 9).alias("middle"), even(F.avg("wall_time_s"), 6).alias("mean"))


@query(f"""{RUNS_SQL} SELECT round(ari, 1) + 0.0::DOUBLE AS a, round(nmi, 1) + 0.0::DOUBLE AS b, count(*) AS n, round(median(wall_time_s), 9) AS wall FROM runs WHERE ari IS NOT NULL AND nmi IS NOT NULL GROUP BY 1, 2""")
def rounded_vector_groups(spark, folder):
    """Runs grouped by a rounded vector of scores."""
    df = runs(spark, folder, "ari", "nmi", "wall_time_s").where("ari is not null and nmi is not null")
    key = F.transform(F.array("ari", "nmi"), lambda x: F.round(x, 1))
    return df.groupBy(key.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("wall_time_s"), 9).alias("wall")).select(F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), "n", "wall")


_STEPS_SQL = f"""WITH steps AS (SELECT * EXCLUDE (cost, delta_cost), {finite_sql("cost")} AS cost, {finite_sql("delta_cost")} AS delta_cost
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step_idx ORDER BY ingested_at DESC) AS t FROM step_records) WHERE t = 1)"""


def _steps(spark, folder) -> DataFrame:
    df = table(spark, folder, "step_records")
    once = df.groupBy("run_id", "step_idx").agg(*[F.max_by(c, "ingested_at").alias(c) for c in ("cost", "delta_cost", "accepted")])
    return clean(once, ["cost", "delta_cost"])


@query(f"{_STEPS_SQL} SELECT run_id, max(step_idx) AS last_step, arg_max(cost, step_idx) FILTER (cost IS NOT NULL) AS final_cost, count(*) AS n_steps FROM steps GROUP BY run_id")
def final_cost(spark, folder):
    """Last known cost, last step and number of steps of each run."""
    known = F.max_by("cost", F.when(F.col("cost").isNotNull(), F.col("step_idx")))
    return _steps(spark, folder).groupBy("run_id").agg(F.max("step_idx").alias("last_step"), known.alias("final_cost"), F.count(F.lit(1)).alias("n_steps"))


@query(f"""{_STEPS_SQL}, r AS (SELECT run_id, step_idx, coalesce(0 - delta_cost, 0) AS reward, row_number() OVER (PARTITION BY run_id ORDER BY step_idx) - 1 AS t FROM steps)
SELECT run_id, step_idx, round(sum(reward * pow(0.95::DOUBLE, t)) OVER (PARTITION BY run_id ORDER BY step_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.95::DOUBLE, t) + 1e-10, 4) + 0.0::DOUBLE AS return_to_go FROM r""")
def returns_to_go(spark, folder):
    """Discounted reward still to come at each step of every episode, however long (the SQL's weights underflow beyond some 14,000 steps, the operator's fold doesn't)."""
    df = _steps(spark, folder).select("run_id", "step_idx", F.coalesce(F.lit(0.0) - F.col("delta_cost"), F.lit(0.0)).alias("reward"))
    return R.discounted_to_go(df, ["run_id"], "step_idx", "reward", 0.95).select("run_id", "step_idx", even("return_to_go", 4).alias("return_to_go"))


@query(f"{_STEPS_SQL} SELECT run_id, step_idx, round(cost - lag(cost) OVER (PARTITION BY run_id ORDER BY step_idx), 9) AS change FROM steps")
def delta_cost(spark, folder):
    """Change of the cost against the step before."""
    w = Window.partitionBy("run_id").orderBy("step_idx")
    return _steps(spark, folder).select("run_id", "step_idx", F.round(F.col("cost") - F.lag("cost").over(w), 9).alias("change"))


@query("SELECT run_id, ('0x' || left(md5(run_id || '|0'), 8))::BIGINT % 10000 < 2000 AS held_out, count(*) AS n FROM step_records GROUP BY 1, 2")
def group_split(spark, folder):
    """A fifth of the runs of step_records held out, whole runs at a time."""
    return R.group_split(table(spark, folder, "step_records"), "run_id", 0.2).groupBy("run_id", "held_out").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq + 1e-10, 6) AS l_quantity, round((l_extendedprice - mp) / sp + 1e-10, 6) AS l_extendedprice, round((l_discount - md) / sd + 1e-10, 6) AS l_discount FROM lineitem, s""")
def zscore_features(spark, folder):
    """Three measures of order lines in standard deviations."""
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in cols])
    return R.zscores(df, cols).withColumns({c: even(c, 6) for c in cols})


_LONG_MEANS = f"""{RUNS_SQL}, means AS (SELECT dataset, algo, avg(ari) AS ari, avg(silhouette) AS silhouette, avg(dunn) AS dunn FROM runs GROUP BY dataset, algo),
long AS (SELECT dataset, algo, 'ari' AS metric, ari AS v, 0.5::DOUBLE AS w FROM means UNION ALL SELECT dataset, algo, 'silhouette', silhouette, 0.3::DOUBLE FROM means UNION ALL SELECT dataset, algo, 'dunn', dunn, 0.2::DOUBLE FROM means),
scaled AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN max(v) OVER p - min(v) OVER p < 1e-12 THEN 1.0::DOUBLE ELSE (v - min(v) OVER p) / (max(v) OVER p - min(v) OVER p) END AS s FROM long WINDOW p AS (PARTITION BY dataset, metric))"""


def _scaled(spark, folder) -> DataFrame:
    means = runs(spark, folder, "dataset", "ari", "silhouette", "dunn").groupBy("dataset", "algo").agg(*[F.avg(m).alias(m) for m in ("ari", "silhouette", "dunn")])
    return R.min_max(R.unpivot(means, ["dataset", "algo"], ["ari", "silhouette", "dunn"], "metric", "v"), ["dataset", "metric"], "v", "s")


@query(f"{_LONG_MEANS} SELECT dataset, algo, metric, round(s + 1e-10, 6) AS scaled FROM scaled")
def probe_scaled(spark, folder):
    """Three mean metrics of each algorithm scaled to 0..1 within a dataset."""
    return _scaled(spark, folder).select("dataset", "algo", "metric", even("s", 6).alias("scaled"))


@query(f"{_LONG_MEANS} SELECT dataset, algo, round(avg(s) + 1e-10, 6) AS score FROM scaled GROUP BY dataset, algo")
def probe_aggregate(spark, folder):
    """Unweighted mean of the scaled metrics that are known."""
    return _scaled(spark, folder).groupBy("dataset", "algo").agg(even(F.avg("s"), 6).alias("score"))


@query(f"{_LONG_MEANS} SELECT dataset, algo, round(sum(CASE WHEN s IS NOT NULL THEN s * w END) / sum(CASE WHEN s IS NOT NULL THEN w END) + 1e-10, 6) AS score FROM scaled GROUP BY dataset, algo")
def probe_weighted(spark, folder):
    """Mean of the scaled metrics with weights renormalised over the known ones."""
    w = F.create_map(*[F.lit(x) for p in (("ari", 0.5), ("silhouette", 0.3), ("dunn", 0.2)) for x in p])
    return _scaled(spark, folder).withColumn("w", w[F.col("metric")]).groupBy("dataset", "algo").agg(even(R.weighted_mean("s", "w"), 6).alias("score"))


@query(f"{RUNS_SQL} SELECT algo, round(regr_slope(ln(wall_time_s), ln(n_samples)) + 1e-10, 6) AS slope, count(*) AS n FROM runs WHERE wall_time_s > 0 GROUP BY algo")
def scaling_slope(spark, folder):
    """Slope of log time over log size for each algorithm."""
    df = runs(spark, folder, "n_samples", "wall_time_s").where("wall_time_s > 0")
    return df.groupBy("algo").agg(even(F.regr_slope(F.log("wall_time_s"), F.log("n_samples")), 6).alias("slope"), F.count(F.lit(1)).alias("n"))


@query(f"{RUNS_SQL} SELECT algo, round(avg(ari / (1 + wall_time_s)) + 1e-10, 6) AS composite, round(avg(ari) / (1 + avg(wall_time_s)) + 1e-10, 6) AS of_means FROM runs GROUP BY algo")
def composite_score(spark, folder):
    """Score per time, as mean of the runs' ratios and as ratio of the means."""
    ratio = F.avg(F.col("ari") / (1 + F.col("wall_time_s")))
    return runs(spark, folder, "ari", "wall_time_s").groupBy("algo").agg(even(ratio, 6).alias("composite"), even(F.avg("ari") / (1 + F.avg("wall_time_s")), 6).alias("of_means"))


@query(f"{RUNS_SQL}, m AS (SELECT algo, round(avg(ari), 9) AS ari FROM runs WHERE algo NOT LIKE 'learned_router%' AND algo NOT LIKE 'meta_%' GROUP BY algo) SELECT algo, ari, row_number() OVER (ORDER BY ari DESC NULLS LAST, algo) AS place FROM m")
def sweep_leaderboard(spark, folder):
    """All algorithms but those that choose others, by mean score, unknown ones last."""
    df = runs(spark, folder, "ari").where(~F.col("algo").startswith("learned_router") & ~F.col("algo").startswith("meta_"))
    means = df.groupBy("algo").agg(F.round(F.avg("ari"), 9).alias("ari"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("ari"), "algo")))


@query("SELECT algo, coalesce(error_type, 'unknown') AS error_type, count(DISTINCT error_id) AS n FROM run_errors GROUP BY 1, 2")
def error_counts(spark, folder):
    """Failed runs by algorithm and kind, repeated rows once."""
    return table(spark, folder, "run_errors").groupBy("algo", F.coalesce("error_type", F.lit("unknown")).alias("error_type")).agg(F.countDistinct("error_id").alias("n"))


@query("SELECT algo, list_sort(list(DISTINCT labels_path))[1] AS first_path, count(DISTINCT labels_path) AS n_paths, count(DISTINCT trajectory_path) AS n_trajectories FROM results GROUP BY algo")
def artifact_index(spark, folder):
    """Artifact paths per algorithm: how many there are and the first."""
    return table(spark, folder, "results").groupBy("algo").agg(F.min("labels_path").alias("first_path"), F.countDistinct("labels_path").alias("n_paths"), F.countDistinct("trajectory_path").alias("n_trajectories"))


@query(f"{RUNS_SQL} SELECT result_id, round(1.0::DOUBLE / (1.0::DOUBLE + wall_time_s) + 1e-10, 6) AS cost_inv FROM runs")
def cost_inverse(spark, folder):
    """One over one plus the time of each run."""
    return runs(spark, folder, "wall_time_s").select("result_id", even(1.0 / (1.0 + F.col("wall_time_s")), 6).alias("cost_inv"))


@query(f"""{_STEPS_SQL}, r AS (SELECT run_id, algo FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) AS t FROM results) WHERE t = 1)
SELECT r.run_id, r.algo, count(s.step_idx) AS n_steps, coalesce(string_agg(s.step_idx, ',' ORDER BY s.step_idx), '') AS step_list, arg_max(coalesce(s.cost, -1), s.step_idx) AS last_cost FROM r LEFT JOIN steps s USING (run_id) GROUP BY r.run_id, r.algo""")
def runs_with_steps(spark, folder):
    """Every current run with its steps nested in order, read back as their indexes, number and last cost (-1 if unknown)."""
    from pointloom.sources.sinks import nested_runs

    heads = R.keep_first(current_runs(spark, folder), ["run_id", "algo"], ["result_id"]).select("run_id", "algo")
    steps = _steps(spark, folder).select("run_id", "step_idx", F.coalesce("cost", F.lit(-1.0)).alias("cost"), "delta_cost", "accepted", F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("state"))
    nested = nested_runs(heads, steps)
    return nested.select("run_id", "algo", F.col("n_steps").cast("long").alias("n_steps"), F.concat_ws(",", F.transform("steps", lambda x: x["step_idx"].cast("string"))).alias("step_list"), F.col("final_cost").alias("last_cost"))


def current_runs(spark, folder) -> DataFrame:
    """Current results by run."""
    from pointloom.operators.deliveries import current_rows

    return current_rows(table(spark, folder, "results"), "result_id", ["run_id", "algo"])
