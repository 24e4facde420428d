"""Best runs of every drawn dataset and seed (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.topn import top_n_per_group
from pointloom.operators.deliveries import MEANT, current_rows, with_meant
from pointloom.operators.staging import stage
from pointloom.sources.tables import table

BEST = 3


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    runs = current_rows(table(spark, folder, "results"), "result_id", ["dataset_id", "seed", "algo", "ari"])
    runs = with_meant(runs, table(spark, folder, "dataset_metadata")).drop("dataset_id").where("ari is not null and not isnan(ari)")
    return top_n_per_group(stage(runs, "scored"), [MEANT, "seed"], "ari", BEST, ["algo", "result_id"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the current results among the first three of their dataset and seed."""
    return _ranked(spark, folder).select("result_id")


def p1_top_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The first three of every dataset and seed with rank, algorithm and score."""
    return _ranked(spark, folder).select(F.col(MEANT).alias("dataset"), "seed", "rank", "algo", "ari", "result_id")


KEY = "translate(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '- ', '__')"
CURRENT_SQL = f"""
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) AS turn FROM results) WHERE turn = 1
), spelled AS (
  SELECT {KEY.format("name")} AS spelling, name AS meant, 0 AS pri FROM dataset_metadata
  UNION ALL SELECT {KEY.format("a")}, name, 1 FROM (SELECT name, unnest(aliases) AS a FROM dataset_metadata)
), look AS (
  SELECT spelling, arg_min(meant, pri) AS meant FROM spelled GROUP BY spelling
), runs AS (
  SELECT l.*, coalesce(k.meant, {KEY.format("l.dataset_id")}) AS dataset
  FROM latest l LEFT JOIN look k ON {KEY.format("l.dataset_id")} = k.spelling
)"""
_TOP = f"""{CURRENT_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, seed ORDER BY CASE WHEN ari = 0 THEN 0.0 ELSE ari END DESC, algo, result_id) AS rank
  FROM runs WHERE ari IS NOT NULL AND ari::VARCHAR <> 'nan'
)"""

QUERIES = {"p1_found": p1_found, "p1_top_runs": p1_top_runs}
SQL = {
    "p1_found": f"{_TOP} SELECT result_id FROM ranked WHERE rank <= {BEST}",
    "p1_top_runs": f"{_TOP} SELECT dataset, seed, CAST(rank AS INTEGER) AS rank, algo, ari, result_id FROM ranked WHERE rank <= {BEST}",
}
