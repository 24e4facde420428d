"""Token ids of all documents (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.tokens import decode_ids, encode_texts
from pointloom.sources.tables import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each document."""
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Number of ids of each document and of distinct ones among them."""
    return p6_ids(spark, folder).select("doc_id", F.size("ids").alias("n_ids"), F.size(F.array_distinct("ids")).alias("n_distinct"))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether decoding gives each document's text back."""
    back = decode_ids(p6_ids(spark, folder), "doc_id").withColumnRenamed("text", "back")
    both = table(spark, folder, "documents").select("doc_id", "text").join(back, "doc_id")
    return both.select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("exact"))


QUERIES = {"p6_ids": p6_ids, "p6_counts": p6_counts, "p6_roundtrip": p6_roundtrip}
SQL = {"p6_roundtrip": "SELECT doc_id, true AS exact FROM documents"}
