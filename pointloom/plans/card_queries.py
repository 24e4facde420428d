"""Queries over algorithm cards: costs, bounds, gaps and mutations, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import cards as C
from pointloom.operators.staging import stage
from pointloom.plans.base import RUNS_SQL, runs
from pointloom.plans.relational_queries import even
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


_TASKS_SQL = f"""{RUNS_SQL}, t AS (SELECT result_id, algo, dataset, wall_time_s, rss_delta_mb, n_samples::DOUBLE AS n, n_features::DOUBLE AS d, greatest(1.0::DOUBLE, coalesce(k_target, 1)::DOUBLE) AS k, n_samples, n_features, k_target, outliers, noise, density FROM runs),
ops AS (SELECT t.*, c.name, CASE time_expr WHEN 'n * n * k' THEN n * n * k WHEN 'n * n * d' THEN n * n * d WHEN 'n * k * d * 20' THEN n * k * d * 20 WHEN 'n * ln(n) * d' THEN n * ln(n) * d END AS ops, CASE memory_expr WHEN 'n * k' THEN n * k WHEN 'n * n' THEN n * n WHEN 'n * d' THEN n * d END AS mem FROM t LEFT JOIN cards c ON c.name = t.algo)"""


def _tasks(spark, folder) -> DataFrame:
    df = runs(spark, folder, "dataset", "n_samples", "n_features", "k_target", "outliers", "noise", "density", "wall_time_s", "rss_delta_mb")
    return df.withColumns({"n": F.col("n_samples").cast("double"), "d": F.col("n_features").cast("double"), "k": F.greatest(F.lit(1.0), F.coalesce(F.col("k_target").cast("double"), F.lit(1.0)))})


def _cards(spark, folder) -> DataFrame:
    return table(spark, folder, "cards")


@query(f"{_TASKS_SQL} SELECT result_id, round(greatest(1e-6, 1e-8 * ops) + 1e-10, 6) AS wall_pred_s, round(greatest(0.001, 8e-6 * mem) + 1e-10, 6) AS rss_pred_mb FROM ops")
def cards_predict(spark, folder):
    """Time and memory that the card of each run's algorithm predicts."""
    return C.with_costs(_tasks(spark, folder), _cards(spark, folder)).select("result_id", even("wall_pred_s", 6).alias("wall_pred_s"), even("rss_pred_mb", 6).alias("rss_pred_mb"))


_CAL_SQL = f"""{_TASKS_SQL}, per AS (SELECT algo, CASE WHEN wall_time_s > 0 THEN wall_time_s / ops END AS a, CASE WHEN rss_delta_mb > 0 THEN rss_delta_mb / mem END AS b FROM ops WHERE name IS NOT NULL),
cal AS (SELECT algo, coalesce(list_sort(list(a) FILTER (a IS NOT NULL))[count(a) // 2 + 1], 1e-8) AS time_cal, coalesce(list_sort(list(b) FILTER (b IS NOT NULL))[count(b) // 2 + 1], 8e-6) AS mem_cal FROM per GROUP BY algo)"""


@query(f"{_CAL_SQL} SELECT algo, round(time_cal * 1e9, 6) AS time_cal, round(mem_cal * 1e6, 6) AS mem_cal FROM cal")
def cards_calibrate(spark, folder):
    """Nanoseconds an operation and bytes a cell of each algorithm, as the runs have it."""
    c = C.calibrate(_tasks(spark, folder), _cards(spark, folder))
    return c.select("algo", F.round(F.col("time_cal") * 1e9, 6).alias("time_cal"), F.round(F.col("mem_cal") * 1e6, 6).alias("mem_cal"))


@query(f"{_CAL_SQL}, r AS (SELECT o.algo, o.wall_time_s / greatest(1e-6, c.time_cal * o.ops) AS ratio FROM ops o JOIN cal c USING (algo) WHERE o.wall_time_s > 0) SELECT algo, round(median(ratio) + 1e-10, 6) AS ratio, count(*) AS n FROM r GROUP BY algo")
def prediction_ratio(spark, folder):
    """Median of actual over calibrated time for each algorithm."""
    tasks = _tasks(spark, folder)
    cal = stage(C.calibrate(tasks, _cards(spark, folder)), "calibration")
    p = C.with_costs(tasks.join(cal, "algo"), _cards(spark, folder), time="time_cal", memory="mem_cal").where("wall_time_s > 0")
    return p.groupBy("algo").agg(even(F.median(F.col("wall_time_s") / F.col("wall_pred_s")), 6).alias("ratio"), F.count(F.lit(1)).alias("n"))


@query(f"{_CAL_SQL}, r AS (SELECT o.algo, round(median(o.wall_time_s) / median(greatest(1e-6, c.time_cal * o.ops)) + 1e-10, 6) AS ratio FROM ops o JOIN cal c USING (algo) WHERE o.wall_time_s IS NOT NULL GROUP BY o.algo), p AS (SELECT *, row_number() OVER (ORDER BY ratio, algo) AS up, row_number() OVER (ORDER BY ratio DESC, algo DESC) AS down FROM r) SELECT algo, ratio, CASE WHEN up <= 5 THEN 'lowest' ELSE 'highest' END AS side FROM p WHERE up <= 5 OR down <= 5")
def prediction_extremes(spark, folder):
    """The five algorithms whose runs took least, and the five whose took most, of what was predicted, by medians."""
    tasks = _tasks(spark, folder)
    cal = stage(C.calibrate(tasks, _cards(spark, folder)), "calibration")
    p = C.with_costs(tasks.join(cal, "algo"), _cards(spark, folder), time="time_cal", memory="mem_cal").where("wall_time_s is not null")
    return C.extremes(p.groupBy("algo").agg(even(F.median("wall_time_s") / F.median("wall_pred_s"), 6).alias("ratio")), "algo", "ratio", 5)


_HINTS_SQL = " + ".join(f"(CASE WHEN contains(lower(dataset), '{w}') THEN 0.25::DOUBLE ELSE 0 END)" for w in C.SHAPE_NAMES)


@query(f"""{RUNS_SQL}, m AS (SELECT *, CASE WHEN coalesce(compactness, 0) = 0 THEN 1.0::DOUBLE ELSE compactness END AS c, CASE WHEN coalesce(k_target, 0) = 0 THEN 2.0::DOUBLE ELSE k_target::DOUBLE END AS fk FROM runs)
SELECT result_id, round(greatest(0, least(1, {_HINTS_SQL} + greatest(0, 1 - c) * 0.5::DOUBLE + least(0.4::DOUBLE, coalesce(noise, 0) * 2.0::DOUBLE))) + 1e-10, 6) AS conv_cv, round(greatest(0, least(1, coalesce(outliers, 0)::DOUBLE + 0.5::DOUBLE * (1 - c))) + 1e-10, 6) AS outlier_frac,
least(n_features::DOUBLE, fk * 2 + 4) AS eff_dim, round(log10(greatest(n_samples::DOUBLE, 10.0::DOUBLE)) / 5 + 1e-10, 6) AS log_n FROM m""")
def mutator_fingerprints(spark, folder):
    """The fingerprint by which mutated cards are scored, of every run."""
    df = runs(spark, folder, "dataset", "n_samples", "n_features", "k_target", "compactness", "outliers", "noise")
    fp = C.mutator_fingerprint(df)
    return fp.select("result_id", even("conv_cv", 6).alias("conv_cv"), even("outlier_frac", 6).alias("outlier_frac"), "eff_dim", even("log_n", 6).alias("log_n"))


_PRIORS_SQL = "priors(dataset, prior_cv, prior_ratio) AS (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in C.PRIORS.items()) + ")"
_FP_SQL = """fp AS (SELECT *, log10(greatest(2.0::DOUBLE, n_samples::DOUBLE)) AS log_n, n_features::DOUBLE AS fd, coalesce(k_target, 1)::DOUBLE AS fk, coalesce(prior_ratio, 1.0::DOUBLE) AS eff_dim_ratio, coalesce(prior_cv, 0.5::DOUBLE) AS conv_cv, coalesce(outliers, 0)::DOUBLE / greatest(1.0::DOUBLE, n_samples::DOUBLE + coalesce(outliers, 0)) AS outlier_frac,
least(1.0::DOUBLE, 1.0::DOUBLE - coalesce(density, 1.0::DOUBLE)) + CASE WHEN coalesce(noise, 0) > 0 THEN 0.1::DOUBLE ELSE 0 END AS density_skew FROM {src} LEFT JOIN priors USING (dataset))"""


@query(f"{RUNS_SQL}, {_PRIORS_SQL}, {_FP_SQL.format(src='runs')} SELECT result_id, round(log_n, 6) AS log_n, round(outlier_frac + 1e-10, 6) AS outlier_frac, round(density_skew + 1e-10, 6) AS density_skew, fd * eff_dim_ratio AS eff_dim, conv_cv FROM fp")
def row_fingerprints(spark, folder):
    """Fingerprint of every run from its parameters."""
    df = runs(spark, folder, "dataset", "n_samples", "n_features", "k_target", "outliers", "noise", "density")
    return C.row_fingerprint(df, C.priors(spark)).select("result_id", F.round("log_n", 6).alias("log_n"), even("outlier_frac", 6).alias("outlier_frac"), even("density_skew", 6).alias("density_skew"), "eff_dim", "conv_cv")


_RULES_SQL = "rules(bias, signal, mode, w) AS (VALUES " + ", ".join(f"('{b}', '{s}', '{m}', {w}::DOUBLE)" for b, s, m, w in C.BIAS_RULES) + ")"


def _bound_sql(fp: str, key: str, cards: str = "SELECT name, unnest(inductive_biases) AS bias FROM cards", names: str = "SELECT name FROM cards") -> str:
    value = "CASE r.signal WHEN 'conv_cv' THEN f.conv_cv WHEN 'outlier_frac' THEN f.outlier_frac WHEN 'eff_dim' THEN f.eff_dim WHEN 'log_n' THEN f.log_n END"
    hit = f"CASE r.mode WHEN 'high' THEN {value} > 0.5 WHEN 'low' THEN {value} < 0.3 WHEN 'low_relative_to_d' THEN f.d > 0 AND {value} / f.d < 0.25 ELSE true END"
    return f"""{_RULES_SQL}, gain AS (SELECT f.{key}, r.bias, CASE WHEN {hit} THEN w ELSE 0 END AS w FROM {fp} f, rules r), cb AS (SELECT DISTINCT * FROM ({cards})),
bounds AS (SELECT f.{key}, n.name AS algo, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + coalesce(s.w, 0))) AS bound FROM {fp} f CROSS JOIN ({names}) n LEFT JOIN (SELECT g.{key}, cb.name, sum(g.w) AS w FROM gain g JOIN cb USING (bias) GROUP BY ALL) s ON s.{key} = f.{key} AND s.name = n.name)"""


_META_FP = "m AS (SELECT name AS id, log10(greatest(2, n_samples)) AS log_n, n_features::DOUBLE AS d, n_features * 0.2::DOUBLE AS eff_dim, CASE domain WHEN 'shapes' THEN 0.9 WHEN 'tabular' THEN 0.1 ELSE 0.5 END::DOUBLE AS conv_cv, CASE domain WHEN 'noise' THEN 0.6 ELSE 0.0 END::DOUBLE AS outlier_frac FROM dataset_metadata)"


@query(f"WITH {_META_FP}, {_bound_sql('m', 'id')} SELECT id, algo, round(bound + 1e-10, 6) AS bound FROM bounds")
def cards_ari_bound(spark, folder):
    """Highest score to expect of each algorithm on each listed dataset."""
    d = F.col("domain")
    fp = table(spark, folder, "dataset_metadata").select(
        F.col("name").alias("id"), F.log10(F.greatest(F.lit(2), "n_samples")).alias("log_n"), F.col("n_features").cast("double").alias("d"), (F.col("n_features") * 0.2).alias("eff_dim"),
        F.when(d == "shapes", 0.9).when(d == "tabular", 0.1).otherwise(0.5).alias("conv_cv"), F.when(d == "noise", 0.6).otherwise(0.0).alias("outlier_frac"),
    )
    return C.ari_bounds(fp, _cards(spark, folder), "id").withColumn("bound", even("bound", 6))


def _grid_sql() -> str:
    size, step, cols = 1, {}, []
    for v in C.AXES.values():
        size *= len(v)
    rest = size
    for name, v in C.AXES.items():
        rest //= len(v)
        step[name] = rest
        cols.append(f"({list(map(float, v))}::DOUBLE[])[(i // {rest}) % {len(v)} + 1] AS {name}")
    stride = size // 500
    return f"grid AS (SELECT *, d * eff_dim_ratio AS eff_dim FROM (SELECT i AS row_number, {', '.join(cols)} FROM range({size}) r(i) WHERE i % {stride} = 0 AND i < {stride * 500}))"


@query(f"WITH {_grid_sql()} SELECT * FROM grid")
def fingerprint_grid(spark, folder):
    """Five hundred fingerprints over seven axes."""
    return C.fingerprint_grid(spark)


_GAP_SQL = f"""{RUNS_SQL}, {_PRIORS_SQL}, {_FP_SQL.format(src='runs')}, ex AS (SELECT min(result_id) AS id, log_n, fd, fk, eff_dim_ratio, conv_cv, outlier_frac, density_skew FROM fp GROUP BY ALL), {_grid_sql()}, {_bound_sql('grid', 'row_number')},
best AS (SELECT row_number, max(bound) AS best FROM bounds GROUP BY row_number),
dist AS (SELECT g.row_number, min(round(sqrt(pow((g.log_n - e.log_n) / 2, 2) + pow((g.d - e.fd) / 200, 2) + pow((g.k - e.fk) / 20, 2) + pow(g.eff_dim_ratio - e.eff_dim_ratio, 2) + pow(g.conv_cv - e.conv_cv, 2) + pow((g.outlier_frac - e.outlier_frac) / 0.2, 2) + pow(g.density_skew - e.density_skew, 2)), 9)) AS distance FROM grid g, ex e GROUP BY g.row_number),
gaps AS (SELECT g.*, b.best, x.distance, round((1 - b.best) * exp(-x.distance), 4) AS interest FROM grid g JOIN best b USING (row_number) JOIN dist x USING (row_number) WHERE b.best < 0.75 ORDER BY interest DESC, row_number LIMIT 20)"""


def _gaps(spark, folder) -> DataFrame:
    df = runs(spark, folder, "dataset", "n_samples", "n_features", "k_target", "outliers", "noise", "density")
    axes = list(C.SPANS)
    known = C.row_fingerprint(df, C.priors(spark)).groupBy(*axes).agg(F.min("result_id").alias("id"))
    return C.gaps(C.fingerprint_grid(spark), _cards(spark, folder), stage(known, "known"), "id", 0.75, 20)


@query(f"{_GAP_SQL} SELECT row_number, round(best + 1e-10, 4) AS best, round(distance + 1e-10, 4) AS distance, interest FROM gaps")
def gap_rank(spark, folder):
    """The twenty fingerprints most worth a benchmark."""
    return _gaps(spark, folder).select("row_number", even("best", 4).alias("best"), even("distance", 4).alias("distance"), "interest")


@query(f"""{_GAP_SQL} SELECT row_number, round_even(pow(10, log_n), 0)::BIGINT AS n_samples, round_even(d, 0)::BIGINT AS n_features, round_even(k, 0)::BIGINT AS centers, round(0.5 + 1.5 * conv_cv, 3) AS compactness,
round_even(outlier_frac * round_even(pow(10, log_n), 0) / (1 - outlier_frac), 0)::BIGINT AS outliers, CASE WHEN density_skew > 0.4 THEN round_even(0.05 * round_even(pow(10, log_n), 0), 0)::BIGINT ELSE 0 END AS noise, round(greatest(0.05, 1 - density_skew), 3) AS density,
round(CASE WHEN outlier_frac > 0 THEN 1 + 4 * outlier_frac ELSE 1 END, 2) AS outlier_extremity FROM gaps""")
def gap_overrides(spark, folder):
    """Generator parameters for each of them."""
    o = C.overrides(_gaps(spark, folder))
    return o.select("row_number", "n_samples", "n_features", "centers", "compactness", "outliers", "noise", "density", "outlier_extremity")


_IMPLIED_SQL = "implied(tag, bias) AS (VALUES " + ", ".join(f"('{t}', '{b}')" for t, bs in C.IMPLIED.items() for b in bs) + ")"


@query(f"""WITH {_IMPLIED_SQL}, s AS (SELECT name, list_distinct(list_append(list_filter(mechanism_tags, lambda t: t <> 'centroid'), 'medoid')) AS tags, inductive_biases FROM cards WHERE list_contains(mechanism_tags, 'centroid') AND NOT list_contains(mechanism_tags, 'medoid')),
i AS (SELECT s.name, list(DISTINCT m.bias) AS bs FROM (SELECT name, unnest(tags) AS tag FROM s) s JOIN implied m USING (tag) GROUP BY s.name)
SELECT 'swap_' || s.name || '_centroid_medoid' AS name, array_to_string(list_sort(tags), ',') AS tags, array_to_string(list_sort(list_distinct(list_concat(list_filter(inductive_biases, lambda b: b NOT IN (SELECT bias FROM implied WHERE tag = 'centroid')), coalesce(bs, [])))), ',') AS biases FROM s LEFT JOIN i USING (name)""".replace("list_filter(inductive_biases, lambda b: b NOT IN (SELECT bias FROM implied WHERE tag = 'centroid'))", "inductive_biases"))
def mutate_swap(spark, folder):
    """Cards whose centroids become medoids."""
    m = C.swap_mechanism(_cards(spark, folder), "centroid", "medoid")
    return m.select("name", F.concat_ws(",", "tags").alias("tags"), F.concat_ws(",", "biases").alias("biases"))


@query("SELECT 'bias_' || name || '_noise_aware' AS name, array_to_string(list_sort(list_distinct(list_append(inductive_biases, 'noise_aware'))), ',') AS biases, '1.2 * (' || time_expr || ')' AS time_expr FROM cards WHERE NOT list_contains(inductive_biases, 'noise_aware')")
def mutate_bias(spark, folder):
    """Cards made aware of noise."""
    return C.add_bias(_cards(spark, folder), "noise_aware").select("name", F.concat_ws(",", "biases").alias("biases"), "time_expr")


_STACK_SQL = """stacked AS (SELECT 'stack_' || a.name || '_' || b.name AS name, list_sort(list_distinct(list_concat(a.mechanism_tags, b.mechanism_tags))) AS tags, list_sort(list_distinct(list_concat(a.inductive_biases, b.inductive_biases))) AS biases FROM cards a JOIN cards b ON a.name < b.name)"""


@query(f"WITH {_STACK_SQL} SELECT name, array_to_string(tags, ',') AS tags, array_to_string(biases, ',') AS biases FROM stacked")
def mutate_stack(spark, folder):
    """Every two cards in sequence."""
    return C.stack(_cards(spark, folder)).select("name", F.concat_ws(",", "tags").alias("tags"), F.concat_ws(",", "biases").alias("biases"))


@query("""SELECT 'cross_' || a.name || '_' || b.name AS name, array_to_string(list_sort(list_distinct(list_concat(list_sort(a.mechanism_tags)[1:(len(a.mechanism_tags) + 1) // 2], list_sort(b.mechanism_tags)[1:(len(b.mechanism_tags) + 1) // 2]))), ',') AS tags FROM cards a JOIN cards b ON a.name < b.name""")
def mutate_crossover(spark, folder):
    """Half of the mechanisms of every two cards."""
    return C.crossover(_cards(spark, folder)).select("name", F.concat_ws(",", "tags").alias("tags"))


@query(f"""WITH {_STACK_SQL}, t AS (SELECT name, list_distinct(list_concat(tags, biases)) AS t FROM stacked), c AS (SELECT name AS card, list_distinct(list_concat(mechanism_tags, inductive_biases)) AS t FROM cards),
j AS (SELECT t.name, c.card, round(len(list_intersect(t.t, c.t))::DOUBLE / len(list_distinct(list_concat(t.t, c.t))), 9) AS s FROM t, c), best AS (SELECT name, arg_max(card, (s, card)) AS card, max(s) AS likeness FROM j GROUP BY name)
SELECT name, card, likeness FROM best WHERE likeness >= 0.85""")
def mutate_dedup(spark, folder):
    """Stacked cards that are nearly a card that exists."""
    cards = _cards(spark, folder)
    return C.near_duplicates(C.stack(cards), cards)


@query(f"""WITH {_META_FP}, {_STACK_SQL}, {_bound_sql('m', 'id', 'SELECT name, unnest(biases) AS bias FROM stacked', 'SELECT name FROM stacked')}, mean AS (SELECT algo AS name, avg(bound) AS score FROM bounds GROUP BY algo),
cb2 AS (SELECT DISTINCT name, unnest(inductive_biases) AS bias FROM cards), base AS (SELECT max(s) AS best FROM (SELECT n.name, avg(greatest(0, least(1, 0.5 + coalesce(w, 0)))) AS s FROM m CROSS JOIN (SELECT name FROM cards) n LEFT JOIN (SELECT g.id, c.name, sum(g.w) AS w FROM gain g JOIN cb2 c USING (bias) GROUP BY ALL) x ON x.id = m.id AND x.name = n.name GROUP BY n.name))
SELECT name, round(score + 1e-10, 6) AS score, round(score - best + 1e-10, 6) AS gain FROM mean, base WHERE round(score - best, 9) >= 0.0 ORDER BY round(score, 9) DESC, name LIMIT 10""")
def mutate_search(spark, folder):
    """The ten stacked cards expected to do best, none worse than every card."""
    cards = _cards(spark, folder)
    d = F.col("domain")
    fp = table(spark, folder, "dataset_metadata").select(
        F.col("name").alias("id"), F.log10(F.greatest(F.lit(2), "n_samples")).alias("log_n"), F.col("n_features").cast("double").alias("d"), (F.col("n_features") * 0.2).alias("eff_dim"),
        F.when(d == "shapes", 0.9).when(d == "tabular", 0.1).otherwise(0.5).alias("conv_cv"), F.when(d == "noise", 0.6).otherwise(0.0).alias("outlier_frac"),
    )
    return C.search(C.stack(cards), fp, cards, "id", gain=0.0).select("name", even("score", 6).alias("score"), even("gain", 6).alias("gain"))


@query("SELECT 'stack_' || a.name || '_' || b.name AS name, 'Run ' || a.name || ', then ' || b.name || ' on what it leaves.' AS text FROM cards a JOIN cards b ON a.name < b.name")
def mutate_suggest(spark, folder):
    """A sentence on every stacked card."""
    return C.suggestion(C.stack(_cards(spark, folder)))
