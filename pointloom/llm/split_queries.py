"""Splits of results that keep each drawn point cloud together (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.splits import assign_splits, related_records
from pointloom.llm.topn_queries import CURRENT_SQL
from pointloom.operators.deliveries import MEANT, current_rows, with_meant
from pointloom.sources.tables import table

#: A share is met if it is missed by less than this part of all records.
NEAR = 0.01
#: split_plan names a handful of splits; a longer table is refused.
MAX_SPLITS = 1000


#: Results on the same drawn point cloud; and, for the wider query, those of one run.
CLOUD, RUN = (MEANT, "seed", "n_samples"), ("run_id",)


def _shares(spark: SparkSession, folder: str) -> dict[str, float]:
    plan = table(spark, folder, "split_plan").select("split_name", "share").limit(MAX_SPLITS + 1).collect()
    if len(plan) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    return {r["split_name"]: r["share"] for r in plan}


def _results(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    runs = current_rows(table(spark, folder, "results"), "result_id", ["dataset_id", "seed", "n_samples", *more])
    return with_meant(runs, table(spark, folder, "dataset_metadata")).select("result_id", *CLOUD, *more)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The smallest result of each drawn point cloud with each other one: the groups that are dealt to splits."""
    found = related_records(_results(spark, folder), "result_id", [CLOUD])
    return found.where("first <> result_id").select(F.col("first").alias("first_result_id"), "result_id")


def p5_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every current result."""
    return assign_splits(_results(spark, folder), "result_id", [CLOUD], _shares(spark, folder)).select("result_id", "split")


def p5_linked_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every current result such that neither a point cloud nor a run is in two."""
    return assign_splits(_results(spark, folder, "run_id"), "result_id", [CLOUD, RUN], _shares(spark, folder)).select("result_id", "split")


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The splits with the share of results that was asked for, and whether it was met."""
    plan = table(spark, folder, "split_plan").select(F.col("split_name").alias("split"), "share")
    got = p5_splits(spark, folder).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    total = got.agg(F.sum("n").alias("total"))  # a single row
    near = F.abs(F.coalesce("n", F.lit(0)) / F.col("total") - F.col("share")) < NEAR
    return plan.join(got, "split", "left").join(F.broadcast(total)).select("split", "share", near.alias("met"))


QUERIES = {"p5_found": p5_found, "p5_splits": p5_splits, "p5_linked_splits": p5_linked_splits, "p5_shares": p5_shares}
SQL = {
    "p5_shares": "SELECT split_name AS split, share, true AS met FROM split_plan",
    "p5_found": f"""{CURRENT_SQL}, firsts AS (
  SELECT result_id, min(result_id) OVER (PARTITION BY dataset, seed, n_samples) AS first_result_id FROM runs
) SELECT first_result_id, result_id FROM firsts WHERE first_result_id <> result_id""",
}
