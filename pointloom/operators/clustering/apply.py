"""Kernels over tables of points."""

from __future__ import annotations

import json
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators import kmeans as K
from pointloom.operators import neighbors as N
from pointloom.operators.clustering import base
from pointloom.operators.clustering import kernels as U
from pointloom.operators.clustering.partition import Summaries
from pointloom.operators.mixture import mixture
from pointloom.operators.staging import discard, stage

#: Points up to which a job per iteration would cost more than the work, so that kernels with a form over partitions run in one memory too.
FIT_ROWS = 5000
#: Starts of k-means and its like, as their kernels have them.
STARTS = {"kmeans": 10, "kmeans_trimmed": 10, "parallel_kmeans": 3}
STEPS = "step_idx int, cost double, delta_cost double, accepted boolean, action string, state string"


class Clustering(NamedTuple):
    """Labels (`point_id`, `label`), what else the kernel says, and its steps as a table."""

    labels: DataFrame
    extra: dict[str, Any]
    trajectory: DataFrame


def _plain(v: Any) -> Any:
    if isinstance(v, np.generic):
        v = v.item()
    return None if isinstance(v, float) and not np.isfinite(v) else v if isinstance(v, (int, float, bool, str, type(None))) else str(v)


def step_rows(steps: list[base.Step]) -> list[tuple]:
    """Steps as rows of `STEPS`."""
    clean = lambda d: json.dumps({k: [_plain(x) for x in v] if isinstance(v, list) else _plain(v) for k, v in d.items()})
    return [(i, _plain(s.cost), _plain(s.delta_cost), bool(s.accepted), clean(s.action), clean(s.state)) for i, s in enumerate(steps)]


#: Summaries of all tasks together that reach the driver.
MAX_SUMMARIES = 20_000


def _birch(points: DataFrame, k: int, threshold: float, branching: int) -> tuple[DataFrame, dict, list[base.Step]]:
    """Summaries of each task's points in a tree of its own, merged in one more tree, then Ward over its leaf entries.

    Tasks together keep `MAX_SUMMARIES` at most: where theirs would be more, their
    threshold grows. Points take the label of the nearest entry.
    """
    tasks = max(1, points.rdd.getNumPartitions())
    most = max(4 * k, MAX_SUMMARIES // tasks)
    shift = np.array(points.agg(F.array(*[F.avg(F.col("x")[i]) for i in range(len(points.first()["x"]))])).first()[0], dtype=np.float64)

    def summarise(limit: float):
        def run(batches):
            tree = Summaries(len(shift), limit, branching, most)
            for batch in batches:
                x = K.matrix(batch.column(1)) - shift if batch.num_rows else np.empty((0, len(shift)))
                tree.add(np.ones(len(x)), x, (x * x).sum(axis=1))
            n, ls, ss = tree.entries()
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(list(ls), type=pa.list_(pa.float64())), pa.array(ss)], names=["n", "ls", "ss"])

        return run

    while True:
        rows = points.select("point_id", "x").mapInArrow(summarise(threshold), "n double, ls array<double>, ss double").toArrow().sort_by([("n", "descending"), ("ss", "ascending")])
        tree = Summaries(len(shift), threshold, branching)
        tree.add(rows["n"].to_numpy(), K.matrix(rows["ls"].combine_chunks()), rows["ss"].to_numpy())
        n, ls, _ = tree.entries()
        if len(n) >= k or threshold < 1e-6:
            break
        threshold *= 0.7
    centers = ls / n[:, None] + shift
    part = U.ward_chain(centers, k, n)
    return _named(points, centers, part), {"n_summaries": len(n), "threshold": threshold}, []


def _named(points: DataFrame, centers: np.ndarray, part: np.ndarray) -> DataFrame:
    """Points with what `part` says of their nearest centre."""

    def name(batches):
        for batch in batches:
            if batch.num_rows:
                at = U.neighbours(K.matrix(batch.column(1)), 1, centers)[1][:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part[at].astype(np.int32))], names=["point_id", "label"])

    return points.select("point_id", "x").mapInArrow(name, "point_id long, label int")


def _minibatch(points: DataFrame, k: int, seed: int, batch: int, max_iter: int, n_init: int) -> tuple[DataFrame, dict, list[base.Step]]:
    """Batches drawn from the table; each moves the centres by a rate of one over what they have seen. The best of `n_init` starts."""
    share = min(1.0, batch / max(1, points.count()))
    best = None
    for i in range(n_init):
        centers = K.plus_plus(points, k, seed + i)
        seen = np.zeros(len(centers))
        for turn in range(max_iter):
            rows = points if share >= 1 else points.sample(share, seed=1000 * (seed + i) + turn)
            target, n, _ = K._means(rows, centers)
            seen += n
            moved = centers + np.where(seen > 0, n / np.maximum(seen, 1), 0.0)[:, None] * (target - centers)
            done = np.abs(moved - centers).max() < 1e-4
            centers = moved
            if done:
                break
        labels = stage(K.assign(points, centers).select("point_id", "label", "sq"), "assigned")
        inertia = float(labels.agg(F.sum("sq")).first()[0])
        if best is None or inertia < best[1]:
            best, labels = (labels, inertia), best and best[0]
        if labels is not None:
            discard(labels)
    return best[0].select("point_id", "label"), {"inertia": best[1]}, []


def _distributed(points: DataFrame, algo: str, k: int | None, seed: int, params: dict) -> tuple[DataFrame, dict, list[base.Step]] | None:
    """Kernels that have a form over partitions: no sample, no bound."""
    if algo in STARTS:
        trim = params.get("trim", 0.1 if algo == "kmeans_trimmed" else 0.0)
        best = None
        for i in range(params.get("n_init", STARTS[algo])):
            fit = K.lloyd(points, K.plus_plus(points, k or 8, seed + i), params.get("max_iter", 300), params.get("tol", 1e-4), trim)
            labels = stage(K.assign(points, fit.centers), "assigned")
            inertia = float(labels.agg(F.sum("sq")).first()[0])
            if best is None or inertia < best[2]:
                best, labels = (fit, labels, inertia), best and best[1]
            if labels is not None:
                discard(labels)
        fit, labels, inertia = best
        kind = {"kmeans": "em", "kmeans_trimmed": "trimmed_em", "parallel_kmeans": "mapreduce"}[algo]
        steps = [base.Step(c, {"type": kind, "shift": s}) for _, c, s in fit.trace]
        return labels.select("point_id", "label"), {"centers": len(fit.centers), "inertia": inertia}, steps
    if algo == "birch_algo":
        return _birch(points, k or 8, params.get("threshold", 1.5), params.get("branching", 50))
    if algo == "minibatch_kmeans":
        return _minibatch(points, k or 8, seed, params.get("batch", 10_000), params.get("max_iter", 100), params.get("n_init", 3))
    if algo == "gmm":
        fit = mixture(points, k or 8, seed, params.get("cov", "full"), params.get("reg", 1e-6))
        return fit.labels, {"bic": fit.bic, "converged": fit.converged}, [base.Step(-t, {"type": "em"}) for t in fit.trace]
    if algo in ("dbscan", "dbscan_auto"):
        least = params.get("min_samples", 5)
        eps = params.get("eps", 0.5)
        if algo == "dbscan_auto":
            near = stage(N.knn(points, least - 1).where(F.col("rk") == least - 1), "curve")
            eps = N.knee(near, "d").first()["eps"]
        return N.dbscan(points, float(eps), least).select("point_id", "label"), {"eps": float(eps)}, []
    return None


def cluster(points: DataFrame, algo: str, k: int | None = None, seed: int = 0, fit_rows: int = FIT_ROWS, **params: Any) -> Clustering:
    """Cluster points (`point_id`, `x`).

    Every kernel sees every point. From more than `fit_rows` points on k-means and its
    like, mini-batches, summaries, the Gaussian mixture and DBSCAN run partition by partition, with the starts,
    rounds and tolerances of the kernels in one memory. The other kernels take all
    points into one memory, however many there are. Null or ragged vectors are an
    error; an empty table gives no labels.
    """
    spark = points.sparkSession
    held = stage(points.select("point_id", F.col("x").cast("array<double>").alias("x")), "points")
    n = held.count()
    if n == 0:
        return Clustering(held.select("point_id", F.lit(0).alias("label")), {}, spark.createDataFrame([], STEPS))
    done = _distributed(held, algo, k, seed, params) if n > fit_rows else None
    if done is not None:
        labels, extra, steps = done
        return Clustering(labels, extra, spark.createDataFrame(step_rows(steps), STEPS))
    rows = held.toArrow().sort_by("point_id")
    fit = base.run(algo, K.matrix(rows["x"].combine_chunks()), k, seed, **params)
    own = spark.createDataFrame(pa.table({"point_id": rows["point_id"], "label": pa.array(fit.labels, pa.int32())}))
    return Clustering(own, fit.extra, spark.createDataFrame(step_rows(fit.steps), STEPS))
