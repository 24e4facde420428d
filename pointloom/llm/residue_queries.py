"""Documents that hold template residue or error pages instead of content (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm.residue import find_residue
from pointloom.sources.tables import table


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with what shows that content is missing."""
    return find_residue(table(spark, folder, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the documents to leave out."""
    return p8_report(spark, folder).select("doc_id")


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that remain."""
    docs = table(spark, folder, "documents")
    return docs.join(p8_found(spark, folder), "doc_id", "left_anti").select("doc_id", "source", "doc_type", "lang")


QUERIES = {"p8_found": p8_found, "p8_report": p8_report, "p8_clean": p8_clean}
