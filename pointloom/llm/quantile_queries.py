"""Percentiles of run times and memory per algorithm and period (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.quantiles import combine, percentiles, summarise
from pointloom.llm.topn_queries import CURRENT_SQL
from pointloom.operators.deliveries import current_rows
from pointloom.operators.staging import stage
from pointloom.sources.tables import table

MEASURES = ("wall_time_s", "rss_delta_mb")


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    runs = current_rows(table(spark, folder, "results"), "result_id", ["algo", "finished_at", *MEASURES])
    return summarise(runs.withColumn("day", F.to_date("finished_at")), ["algo", "day"], MEASURES)


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per algorithm and day, per month and over all days, the longer periods combined from the summaries of the days."""
    daily = stage(_daily(spark, folder), "daily")
    monthly = stage(combine(daily.withColumn("month", F.date_format("day", "yyyy-MM")), ["algo", "month"]), "monthly")
    whole = combine(monthly, ["algo"]).withColumn("period", F.lit("all"))
    days = daily.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumnRenamed("day", "period")
    periods = days.unionByName(monthly.withColumnRenamed("month", "period")).unionByName(whole)
    return percentiles(periods).select("algo", "period", "measure", "n", "p50", "p90", "p95", "p99")


def p3_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per algorithm and day with the bound on their error in ranks."""
    return percentiles(_daily(spark, folder))


_ONE = """SELECT algo, period, measure, count(*) AS n, {q} FROM (
  SELECT *, row_number() OVER (PARTITION BY algo, period, measure ORDER BY x) AS r, count(*) OVER (PARTITION BY algo, period, measure) AS c FROM long
) GROUP BY algo, period, measure""".format(q=", ".join(f"max(CASE WHEN r = (c * {q} + 999) // 1000 THEN x END) AS p{q // 10}" for q in (500, 900, 950, 990)))

QUERIES = {"p3_percentiles": p3_percentiles, "p3_daily": p3_daily}
#: Exact percentiles; the summaries are exact as long as no key has filled a buffer, as on the tables the SQL is run on.
SQL = {
    "p3_percentiles": f"""{CURRENT_SQL}, long AS (
  SELECT algo, period, measure, x FROM (
    SELECT algo, finished_at, unnest(['wall_time_s', 'rss_delta_mb']) AS measure, unnest([wall_time_s, rss_delta_mb]) AS x FROM latest
  ), LATERAL (SELECT unnest(['all', strftime(finished_at, '%Y-%m'), strftime(finished_at, '%Y-%m-%d')]) AS period)
  WHERE x IS NOT NULL AND x::VARCHAR <> 'nan'
) {_ONE}""",
    "p3_daily": f"""{CURRENT_SQL}, long AS (
  SELECT algo, CAST(finished_at AS DATE) AS period, measure, x FROM (
    SELECT algo, finished_at, unnest(['wall_time_s', 'rss_delta_mb']) AS measure, unnest([wall_time_s, rss_delta_mb]) AS x FROM latest
  ) WHERE x IS NOT NULL AND x::VARCHAR <> 'nan'
) SELECT * EXCLUDE (period), period AS day, 0 AS rank_error FROM ({_ONE})""",
}
