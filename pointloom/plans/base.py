"""What several queries start from: current results, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.deliveries import current_rows, with_meant
from pointloom.sources.tables import table

#: The columns that tell one task (a drawn point cloud and how it is clustered) from another.
TASK = ("dataset", "n_samples", "n_features", "k_target", "compactness", "seed", "outliers", "noise", "density", "outlier_extremity")
METRICS = ("ari", "nmi", "silhouette", "davies_bouldin", "dunn", "separation", "metric_compactness", "wall_time_s", "rss_delta_mb")


def clean(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """NaN and infinities of `columns` as null."""
    inf = float("inf")
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != inf), F.col(c)) for c in columns})


def runs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Current results, the dataset meant as `dataset`, measures without NaN; only `columns` beside result_id and algo."""
    wanted = [c for c in dict.fromkeys(["algo", *columns]) if c != "dataset"]
    read = [*wanted, *(["dataset_id"] if "dataset" in columns else [])]
    df = current_rows(table(spark, folder, "results"), "result_id", read)
    if "dataset" in columns:
        df = with_meant(df, table(spark, folder, "dataset_metadata"), out="dataset").drop("dataset_id")
    return clean(df, [c for c in wanted if c in METRICS])


_KEY = "translate(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '- ', '__')"


def finite_sql(c: str) -> str:
    """SQL for `c` with NaN and infinities as null; by its text, as DuckDB may conclude from file statistics, which leave NaN out, that isnan() never holds."""
    return f"CASE WHEN {c}::VARCHAR NOT IN ('nan', '-nan', 'inf', '-inf') THEN {c} END"


_CLEAN = ", ".join(f"{finite_sql(c)} AS {c}" for c in METRICS)
#: Starts a WITH: `runs` as above with all columns.
RUNS_SQL = f"""WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) AS turn FROM results) WHERE turn = 1
), spelled AS (
  SELECT {_KEY.format("name")} AS spelling, name AS meant, 0 AS pri FROM dataset_metadata
  UNION ALL SELECT {_KEY.format("a")}, name, 1 FROM (SELECT name, unnest(aliases) AS a FROM dataset_metadata)
), look AS (SELECT spelling, arg_min(meant, pri) AS meant FROM spelled GROUP BY spelling
), runs AS (
  SELECT l.* EXCLUDE ({", ".join(METRICS)}), {_CLEAN}, coalesce(k.meant, {_KEY.format("l.dataset_id")}) AS dataset
  FROM latest l LEFT JOIN look k ON {_KEY.format("l.dataset_id")} = k.spelling
)"""
