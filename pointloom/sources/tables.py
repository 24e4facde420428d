"""Table loaders: one folder of parquet tables, read with the columns a plan asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` of `folder`; pruning and pushdown are Catalyst's."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
