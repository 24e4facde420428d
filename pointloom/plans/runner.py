"""Grids of tasks and algorithms, run as one job.

A run is a task (a generated cloud) and an algorithm; runs are independent and
small, so they are the rows of a table that the cluster works off. A run that fails
is a row of the errors, never the end of the job.
"""

from __future__ import annotations

import itertools
import json
import os
import subprocess
import tempfile
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.clustering import base
from pointloom.operators.clustering import kernels as U
from pointloom.operators.clustering.apply import step_rows
from pointloom.operators.clustering.routers import probe_metrics
from pointloom.operators.staging import stage
from pointloom.sources.generators import DataSpec, draw

TASK = "dataset_id string, n_samples int, n_features int, k_target int, compactness double, seed int, outliers int, noise int, density double, outlier_extremity double"
MEASURES = "wall_time_s double, rss_delta_mb double, cpu_user_s double, cpu_system_s double, read_bytes bigint, write_bytes bigint, n_clusters_found int, n_steps int, ari double, nmi double, silhouette double, davies_bouldin double, dunn double, separation double, metric_compactness double, extra string"
STEP = "array<struct<step_idx: int, cost: double, delta_cost: double, accepted: boolean, action: string, state: string>>"
RUN = f"run_id string, algo string, {TASK}, {MEASURES}, labels array<int>, steps {STEP}, error_type string, error_message string"


#: Points of a cluster that Dunn's index of a run takes, and of a run that its silhouette takes.
DUNN_ROWS, SILHOUETTE_ROWS = 2000, 5000


@dataclass(frozen=True)
class Algorithm:
    """A registered kernel, or with `entry` an external program."""

    name: str
    params: Mapping[str, Any] = field(default_factory=dict)
    entry: str | None = None


class Outcome(NamedTuple):
    """Results, step records and failed runs."""

    results: DataFrame
    trajectories: DataFrame
    labels: DataFrame
    errors: DataFrame


def expand(grid: Mapping[str, Any]) -> list[dict[str, Any]]:
    """Tasks of a grid: the product of its axes (`datasets`, `n_samples`, `n_features`, `k`, `compactness`, `seeds`, `outliers`, `noise`, `density`, `outlier_extremity`)."""
    axes = [("dataset_id", "datasets", ["blobs"]), ("n_samples", "n_samples", [500]), ("n_features", "n_features", [4]), ("k_target", "k", [3]), ("compactness", "compactness", [1.0]), ("seed", "seeds", [1]), ("outliers", "outliers", [0]), ("noise", "noise", [0]), ("density", "density", [1.0]), ("outlier_extremity", "outlier_extremity", [1.0])]
    values = [v if isinstance(v := grid.get(key, default), list) else [v] for _, key, default in axes]
    return [dict(zip([a for a, _, _ in axes], row, strict=True)) for row in itertools.product(*values)]


def _io() -> tuple[int, int]:
    try:
        held = dict(line.split(": ") for line in Path("/proc/self/io").read_text().splitlines())
        return int(held["read_bytes"]), int(held["write_bytes"])
    except (OSError, KeyError, ValueError):
        return 0, 0


def _rss() -> float:
    try:
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
    except (OSError, ValueError):
        return 0.0


def score(x: np.ndarray, y: np.ndarray, labels: np.ndarray) -> dict[str, float | None]:
    """Measures of a run; undefined ones are None."""
    keep = labels >= 0
    names = np.unique(labels[keep])
    c = np.array([x[labels == n].mean(axis=0) for n in names])
    spread = [float(((x[labels == n] - m) ** 2).sum(axis=1).mean()) for n, m in zip(names, c, strict=True) if (labels == n).sum() > 1]
    table = pd.crosstab(y, labels).to_numpy().astype(float)
    p, n = table / table.sum(), table.sum()
    pa, pb = p.sum(axis=1), p.sum(axis=0)
    outer = np.outer(pa, pb)
    mi = float((p[p > 0] * np.log(p[p > 0] / outer[p > 0])).sum())
    h = float(-(pa[pa > 0] * np.log(pa[pa > 0])).sum() - (pb[pb > 0] * np.log(pb[pb > 0])).sum()) / 2
    probe = probe_metrics(x, np.unique(labels, return_inverse=True)[1], purity=False, most=SILHOUETTE_ROWS)
    dunn = None
    if len(names) > 1:
        rng = np.random.default_rng(0)
        rows = np.concatenate([r if len(r) <= DUNN_ROWS else rng.choice(r, DUNN_ROWS, replace=False) for r in (np.flatnonzero(labels == v) for v in names)])
        held, own = x[rows], labels[rows]
        near, wide = np.inf, 0.0
        for at in range(0, len(rows), 1000):
            d = U.sq_dists(held[at : at + 1000], held)
            same = own[at : at + 1000, None] == own[None, :]
            near = min(near, float(np.min(d, initial=np.inf, where=~same)))
            wide = max(wide, float(np.max(d, initial=0.0, where=same)))
        dunn = float(np.sqrt(near / wide)) if wide > 0 else None
    sep = float(U.sq_dists(c, c)[np.triu_indices(len(c), 1)].mean()) if len(c) > 1 else None
    db = probe["db_inverse"]
    out = {"ari": U.ari(y, labels), "nmi": 1.0 if h <= 1e-15 else mi / h, "silhouette": probe["silhouette"], "davies_bouldin": 1 / db - 1 if db and n else None, "dunn": dunn, "separation": sep, "metric_compactness": float(np.mean(spread)) if spread else None}
    return {k: None if v is None or not np.isfinite(v) else float(v) for k, v in out.items()}


def run_external(entry: str, x: np.ndarray, k: int | None, params: Mapping[str, Any], timeout: float | None = None) -> base.Fit:
    """Run a program that reads a JSON request on stdin and writes labels.

    The request names `data_path` (.npy), `k`, `params`, `artifacts_dir` and
    `labels_path`; the program must write the labels there and may print a JSON object
    with `extra`. A non-zero exit, missing labels or the timeout are errors; anything
    else that it prints is ignored.
    """
    with tempfile.TemporaryDirectory(prefix="pointloom-run-") as folder:
        data, labels = f"{folder}/x.npy", f"{folder}/labels.npy"
        np.save(data, x)
        request = json.dumps({"data_path": data, "k": k, "params": dict(params), "artifacts_dir": folder, "labels_path": labels})
        done = subprocess.run(entry.split(), input=request, capture_output=True, text=True, timeout=timeout)
        if done.returncode:
            raise RuntimeError(f"{entry} ended with {done.returncode}: {done.stderr[-300:]}")
        if not Path(labels).exists():
            raise RuntimeError(f"{entry} wrote no labels")
        try:
            extra = json.loads(done.stdout).get("extra", {})
        except (ValueError, AttributeError):
            extra = {}
        return base.Fit(np.load(labels), extra)


def run_one(task: Mapping[str, Any], algo: Algorithm, timeout: float | None = None) -> dict[str, Any]:
    """A run as a row of `RUN`."""
    out: dict[str, Any] = {f.split(" ")[0]: None for f in RUN.replace(STEP, "s").split(", ")}
    out |= {"run_id": uuid.uuid4().hex, "algo": algo.name} | dict(task)
    try:
        spec = DataSpec(task["n_samples"], task["n_features"], task["k_target"] or 3, task["compactness"], task["seed"], task["outliers"], task["noise"], task["density"], task["outlier_extremity"])
        x, y = draw(task["dataset_id"], spec)
        began, cpu, io, rss = time.perf_counter(), os.times(), _io(), _rss()
        fit = run_external(algo.entry, x, task["k_target"], algo.params, timeout) if algo.entry else base.run(algo.name, x, task["k_target"], task["seed"], **algo.params)
        measures = score(np.asarray(x, dtype=np.float64), y, fit.labels)
        after, io2 = os.times(), _io()
        out |= measures | {
            "wall_time_s": time.perf_counter() - began, "rss_delta_mb": _rss() - rss, "cpu_user_s": after.user - cpu.user, "cpu_system_s": after.system - cpu.system, "read_bytes": io2[0] - io[0], "write_bytes": io2[1] - io[1],
            "n_clusters_found": int(len(np.unique(fit.labels[fit.labels >= 0]))), "n_steps": len(fit.steps), "extra": json.dumps(fit.extra, default=str), "labels": [int(v) for v in fit.labels],
            "steps": [dict(zip(("step_idx", "cost", "delta_cost", "accepted", "action", "state"), r, strict=True)) for r in step_rows(fit.steps)],
        }
    except Exception as e:  # a failed run is a result, too
        out |= {"error_type": type(e).__name__, "error_message": str(e)[:500]}
    return out


def run_grid(spark: SparkSession, tasks: Sequence[Mapping[str, Any]] | DataFrame, algorithms: Sequence[Algorithm], timeout: float | None = None) -> Outcome:
    """Run every algorithm on every task; the outcome is staged once, then split into tables."""
    frame = tasks if isinstance(tasks, DataFrame) else spark.createDataFrame([tuple(t[f.split(" ")[0]] for f in TASK.split(", ")) for t in tasks], TASK)
    by_name = {a.name: a for a in algorithms}
    pairs = frame.withColumn("algo", F.explode(F.array(*[F.lit(a) for a in by_name])))
    spread = pairs.repartition(max(1, min(frame.count() * len(by_name), 4 * spark.sparkContext.defaultParallelism)))
    columns = [f.split(" ")[0] for f in RUN.replace(STEP, "s").split(", ")]

    def work(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                algo = by_name[row.pop("algo")]
                clean = {k: None if v is None or v != v else v.item() if isinstance(v, np.generic) else v for k, v in row.items()}
                whole = {k: int(v) if v is not None and k in ("n_samples", "n_features", "k_target", "seed", "outliers", "noise") else v for k, v in clean.items()}
                yield pd.DataFrame([run_one(whole, algo, timeout)], columns=columns)

    done = stage(spread.mapInPandas(work, RUN), "runs")
    good, task = done.where("error_type is null"), [f.split(" ")[0] for f in TASK.split(", ")]
    steps = good.select("run_id", "algo", *task, F.explode("steps").alias("s")).select("run_id", "algo", *task, "s.*")
    labels = good.select("run_id", F.posexplode("labels").alias("point_id", "label"))
    return Outcome(good.drop("labels", "steps", "error_type", "error_message"), steps, labels, done.where("error_type is not null").select("algo", *task, "error_type", "error_message"))


def main(argv: Sequence[str] | None = None) -> None:
    """`python -m pointloom.plans.runner --config grid.yaml --out folder`: run a grid and write its tables, manifest and summary."""
    import argparse

    from pointloom.operators.relational import average_ranks, friedman
    from pointloom.session import local_session
    from pointloom.sources import sinks

    parser = argparse.ArgumentParser()
    parser.add_argument("--config", required=True)
    parser.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    text = Path(args.config).read_text()
    try:
        import yaml

        config = yaml.safe_load(text)
    except ImportError:
        config = json.loads(text)
    spark = local_session()
    tasks = expand(config.get("grid", config))
    algorithms = [Algorithm(a) if isinstance(a, str) else Algorithm(a["name"], a.get("params") or {}, a.get("entry")) for a in config["algorithms"]]
    out = run_grid(spark, tasks, algorithms)
    sinks.write_results(out.results, args.out)
    sinks.write_trajectories(out.trajectories, args.out)
    sinks.write_errors(out.errors, args.out)
    out.labels.write.mode("overwrite").parquet(f"{args.out}/labels.parquet")
    keys = [f.split(" ")[0] for f in TASK.split(", ")]
    sinks.write_json(spark, {"generated_at": time.strftime("%Y-%m-%dT%H:%M:%S"), "n_tasks": len(tasks), "algorithms": [a.name for a in algorithms]}, f"{args.out}/manifest.json")
    summary = {}
    for metric, up in (("ari", True), ("wall_time_s", False)):
        ranks = average_ranks(out.results, metric, keys, higher=up).orderBy("avg_rank").collect()  # a row per algorithm
        test = friedman(out.results, metric, keys, higher=up).first()
        summary[metric] = {"average_ranks": {r["algo"]: r["avg_rank"] for r in ranks}, "friedman": test.asDict() if test["statistic"] is not None else {"error": "no complete tasks"}}
    sinks.write_json(spark, summary, f"{args.out}/summary.json")


if __name__ == "__main__":
    main()
