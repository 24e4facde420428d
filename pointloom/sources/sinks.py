"""Reading and writing of run directories."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.relational import upsert
from pointloom.operators.staging import stage


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by the ending of its path: parquet, csv with header, orc, tsv, or json (an array or a row a line)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind in ("csv", "tsv"):
        return reader.csv(path, header=kind == "csv", sep="," if kind == "csv" else "\t", inferSchema=schema is None)
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    if kind == "jsonl":
        return reader.json(path)
    if kind == "orc":
        return reader.orc(path)
    return reader.parquet(path)


def read_results(spark: SparkSession, folder: str, name: str = "results") -> DataFrame:
    """A run directory's table: the parquet one, or the csv one where that is missing or can't be read."""
    try:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    except (AnalysisException, PySparkException):
        return read_table(spark, f"{folder}/{name}.csv")


def read_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of a JSON file that must hold an array of objects; anything else is an error."""
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1)).first()
    if first is None or first[0] != "[":
        raise ValueError(f"{path} doesn't hold an array")
    return read_table(spark, path, schema)


def write_metrics(df: DataFrame, folder: str, run: str = "run_id") -> None:
    """The measures of each run as a JSON object of its own, in a folder per run."""
    df.write.mode("overwrite").partitionBy(run).json(f"{folder}/metrics.json")


def write_report(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, most: int = 10_000) -> None:
    """A JSON report of small tables (gaps, suggested mutations, calibrations, diagnostics) by name, rows as objects.

    A table of more than `most` rows isn't a report and is refused.
    """
    held = {}
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        held[name] = [r.asDict(recursive=True) for r in rows]
    write_json(spark, held, path)


def write_results(df: DataFrame, folder: str) -> None:
    """Results as parquet and as csv."""
    df.write.mode("overwrite").parquet(f"{folder}/results.parquet")
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "map", "array")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(f"{folder}/results.csv", header=True)


def write_trajectories(df: DataFrame, folder: str) -> None:
    """Step records, a folder per algorithm; as csv where parquet can't hold them."""
    try:
        df.write.mode("overwrite").partitionBy("algo").parquet(f"{folder}/trajectories.parquet")
    except AnalysisException:
        flat = [F.to_json(c).alias(c) if t.startswith(("struct", "map", "array")) else F.col(c).cast("string").alias(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").partitionBy("algo").csv(f"{folder}/trajectories.csv", header=True)


def write_errors(df: DataFrame, folder: str) -> None:
    """Failed runs, a JSON object a line."""
    df.write.mode("overwrite").json(f"{folder}/errors.json")


def write_json(spark: SparkSession, value: Mapping[str, Any], path: str) -> None:
    """A small JSON file (a manifest or summary) wherever the session can write."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(target, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, default=str).encode("utf-8")))
    finally:
        out.close()


def nested_runs(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per run with its steps in order as an array, their number and the last cost; runs without steps keep an empty array."""
    step = F.struct("step_idx", "cost", "delta_cost", "accepted", "action", "state")
    each = steps.groupBy("run_id").agg(F.sort_array(F.collect_list(step)).alias("steps"), F.max_by("cost", "step_idx").alias("final_cost"))
    empty = F.array().cast(each.schema["steps"].dataType)
    return runs.join(each, "run_id", "left").withColumn("steps", F.coalesce("steps", empty)).withColumn("n_steps", F.size("steps"))


# The columns that a dashboard shows of a result, in order; the experiment's compactness comes last.
DASHBOARD = (
    "algo", "dataset_id", "n_samples", "n_features", "k_target", "seed", "outliers", "noise", "density", "ari", "nmi", "silhouette", "davies_bouldin", "dunn", "wall_time_s", "rss_delta_mb", "cpu_user_s", "cpu_system_s",
    "n_clusters_found", "n_steps", "theoretical_wall_time_s", "theoretical_rss_mb", "theoretical_ari_upper_bound", "dataset_source", "dataset_domain", "outlier_extremity",
)


def dashboard(df: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Columns `also` and the dashboard's columns that `df` has, NaN and infinities as null, and compactness as a number (null if it is none)."""
    shown = [c for c in dict.fromkeys((*also, *DASHBOARD, "compactness")) if c in df.columns]
    kinds = dict(df.dtypes)
    inf = float("inf")

    def plain(c: str):
        if c == "compactness" and kinds[c] == "string":
            return F.col(c).try_cast("double").alias(c)
        if kinds[c] in ("double", "float"):
            return F.when(~F.isnan(c) & (F.abs(c) != inf), F.col(c)).alias(c)
        return F.col(c)

    return df.select(*[plain(c) for c in shown])


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(`path`, `point_id`, `x`): the rows of matrices in `.npy` files, a file a task; a vector is a matrix of one column."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.load(io.BytesIO(raw), allow_pickle=False)
                x = np.asarray(x, dtype=np.float64).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), type=pa.string()), pa.array(np.arange(len(x))), pa.array(list(x), type=pa.list_(pa.float64()))], names=["path", "point_id", "x"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(load, "path string, point_id long, x array<double>")


def append_runs(existing: DataFrame, new: DataFrame, keys: list[str], folder: str) -> dict[str, int]:
    """Merge new runs into existing ones by `keys`, write the result, and count what happened."""
    merged = stage(upsert(existing, new, keys), "merged")
    before, added, after = existing.count(), new.count(), merged.count()
    merged.write.mode("overwrite").parquet(f"{folder}/results.parquet")
    return {"before": before, "delivered": added, "after": after, "replaced": before + added - after}


def export_by_algo(df: DataFrame, folder: str) -> DataFrame:
    """A folder per algorithm, and an index of the artifact paths each has."""
    df.write.mode("overwrite").partitionBy("algo").parquet(f"{folder}/by_algo.parquet")
    return df.groupBy("algo").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("labels_path")).alias("labels_paths"), F.sort_array(F.collect_set("trajectory_path")).alias("trajectory_paths"))
