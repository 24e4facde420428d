"""Current rows of tables whose rows arrive more than once, and names spelled in several ways."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEANT = "__pl_meant"


def current_rows(df: DataFrame, key: str, columns: Sequence[str], by: str = "ingested_at") -> DataFrame:
    """The latest delivery of each `key`: `key` and `columns`, one row a key.

    The maximum of (`by`, columns) is taken by a partial aggregation, so that a key
    delivered many times is reduced before the shuffle. Rows without a key can't be
    told apart and are left out; a null `by` is older than any time; of different
    rows with equal times the greatest in column order is taken. An empty table
    gives an empty table; other columns of the input don't matter.
    """
    packed = F.max(F.struct(F.col(by).alias("__pl_at"), *[F.col(c) for c in columns])).alias("__pl_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(packed).select(key, *[F.col(f"__pl_row.{c}").alias(c) for c in columns])


def name_key(name: Column) -> Column:
    """A spelling-free form of a name: case and outer white space dropped, '-' and blank as '_'."""
    return F.translate(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), "- ", "__")


def name_lookup(names: DataFrame, name: str = "name", aliases: str = "aliases") -> DataFrame:
    """(`spelling`, `meant`): each name and alias in its spelling-free form, names before aliases."""
    own = names.select(name_key(F.col(name)).alias("spelling"), F.lit(0).alias("rank"), F.col(name).alias("meant"))
    other = names.select(F.explode(aliases).alias("a"), F.col(name).alias("meant")).select(
        name_key(F.col("a")).alias("spelling"), F.lit(1).alias("rank"), "meant"
    )
    first = F.min(F.struct("rank", "meant")).alias("first")
    return own.unionByName(other).where("spelling is not null").groupBy("spelling").agg(first).select("spelling", F.col("first.meant").alias("meant"))


def with_meant(df: DataFrame, names: DataFrame, column: str = "dataset_id", out: str = MEANT) -> DataFrame:
    """Add `out`, the listed name that `column` means; an unlisted one keeps its spelling-free form, null stays null.

    The list is joined by Spark's own choice of strategy: broadcast while its size is
    below the session's threshold, by shuffle beyond.
    """
    look = name_lookup(names).select(F.col("spelling").alias("__pl_spelling"), F.col("meant").alias("__pl_listed"))
    keyed = df.withColumn("__pl_spelled", name_key(F.col(column)))
    joined = keyed.join(look, F.col("__pl_spelled") == F.col("__pl_spelling"), "left")
    return joined.withColumn(out, F.coalesce("__pl_listed", "__pl_spelled")).drop("__pl_spelled", "__pl_spelling", "__pl_listed")
