"""Queries that write tables as a run directory has them and read them back, each with its SQL over the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.staging import shared_dir
from pointloom.plans.base import clean, finite_sql
from pointloom.sources import sinks
from pointloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pointloom/{name}-{uuid.uuid4().hex}"


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return clean(table(spark, folder, "results"), ["ari", "nmi"]).select("result_id", "run_id", "algo", "ari", "nmi")


_RESULTS_SQL = f"SELECT result_id, run_id, algo, {finite_sql('ari')} AS ari, {finite_sql('nmi')} AS nmi FROM results"


@query(_RESULTS_SQL)
def results_parquet(spark, folder):
    """Results of a run directory, read from its parquet table."""
    at = _folder(spark, "run")
    sinks.write_results(_results(spark, folder), at)
    return sinks.read_results(spark, at)


@query(_RESULTS_SQL)
def results_csv_fallback(spark, folder):
    """Results of a run directory whose parquet table is missing, read from the csv one."""
    at = _folder(spark, "run")
    df = _results(spark, folder)
    df.write.csv(f"{at}/results.csv", header=True)
    return sinks.read_results(spark, at).select("result_id", "run_id", "algo", F.col("ari").cast("double").alias("ari"), F.col("nmi").cast("double").alias("nmi")).withColumn("result_id", F.col("result_id").cast("long"))


@query("SELECT error_id, algo, coalesce(error_type, 'unknown') AS error_type, left(error_message, 500) AS error_message FROM run_errors")
def errors_json(spark, folder):
    """Failed runs written as JSON lines and read back."""
    at = _folder(spark, "run")
    errors = table(spark, folder, "run_errors").select("error_id", "algo", F.coalesce("error_type", F.lit("unknown")).alias("error_type"), F.substring("error_message", 1, 500).alias("error_message"))
    sinks.write_errors(errors, at)
    return spark.read.schema(errors.schema).json(f"{at}/errors.json")


@query("SELECT run_id, step_idx, algo, accepted, action, state FROM step_records")
def trajectories_by_algo(spark, folder):
    """Step records written with a folder per algorithm and read back."""
    at = _folder(spark, "run")
    sinks.write_trajectories(table(spark, folder, "step_records").select("run_id", "step_idx", "algo", "accepted", "action", "state"), at)
    return spark.read.parquet(f"{at}/trajectories.parquet")


@query(f"SELECT algo, count(*) AS n, round(sum({finite_sql('ari')}), 6) AS ari FROM (SELECT DISTINCT result_id, algo, ari FROM results) GROUP BY algo")
def metrics_json(spark, folder):
    """Measures of each result as JSON objects, a folder per algorithm here, read back and summed."""
    at = _folder(spark, "run")
    sinks.write_metrics(_results(spark, folder).select("result_id", "algo", "ari").distinct(), at, "algo")
    back = spark.read.schema("result_id long, ari double, algo string").json(f"{at}/metrics.json")
    return back.groupBy("algo").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ari"), 6).alias("ari"))


_SHOWN = ("ari", "nmi", "silhouette", "davies_bouldin", "dunn", "wall_time_s", "rss_delta_mb", "cpu_user_s", "cpu_system_s", "density", "outlier_extremity", "compactness")
_AS_IS = ("algo", "dataset_id", "n_samples", "n_features", "k_target", "seed", "outliers", "noise", "n_clusters_found", "n_steps", "dataset_source", "dataset_domain")


@query(f"SELECT result_id, {', '.join(_AS_IS)}, {', '.join(f'{finite_sql(c)} AS {c}' for c in _SHOWN)} FROM results")
def dashboard_rows(spark, folder):
    """Every result as a dashboard shows it, with its id."""
    return sinks.dashboard(table(spark, folder, "results"), ["result_id"])


@query("SELECT name, family, handles_k_directly FROM cards")
def cards_json_array(spark, folder):
    """Cards written as one JSON array and read back as rows."""
    at = _folder(spark, "cards")
    rows = table(spark, folder, "cards").select("name", "family", "handles_k_directly").limit(1000).collect()  # a dimension table
    sinks.write_json(spark, [r.asDict() for r in rows], f"{at}/cards.json")
    return sinks.read_rows(spark, f"{at}/cards.json", "name string, family string, handles_k_directly boolean")
