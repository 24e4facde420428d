"""What algorithms did on past tasks, with the fingerprint of each task: what the learned routers learn from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.clustering import fingerprints as P
from pointloom.operators.clustering.routers import History
from pointloom.operators.staging import stage
from pointloom.plans.base import TASK, runs
from pointloom.sources.generators import GENERATORS, DataSpec, draw
from pointloom.sources.tables import table

#: Tasks that a router learns from at most: those with the most algorithms, ties by hash. A documented bound on a labelled sample.
MAX_TASKS = 200
#: What tells one past task from another: runs that differ in other parameters only are draws of one task.
KEY = ("dataset", "n_samples", "n_features", "k_target")
#: Generators that stand in for listed datasets which have none, by domain; others are drawn as `OTHERWISE`.
STAND_INS = {"tabular": "mdcgen", "shapes": "moons", "time-series": "ts_synth", "timeseries": "ts_synth", "graph": "graph_sbm", "image": "digits", "text": "text20news"}
OTHERWISE = "varying_density"


def task_history(tasks: DataFrame, generator: str = "generator", seed: int = 0) -> DataFrame:
    """Add `features`, the fingerprint (all versions' features) of each task's cloud, drawn anew by its `generator`.

    `tasks` has the columns of a task (see `plans.base.TASK`) and a generator's name. A
    task whose cloud can't be drawn has null features.
    """

    def read(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                num = lambda c, d, row=row: d if row[c] is None or row[c] != row[c] else row[c]
                try:
                    spec = DataSpec(int(row["n_samples"]), int(row["n_features"]), int(num("k_target", 2)), float(num("compactness", 1.0)), int(row["seed"]), int(num("outliers", 0)), int(num("noise", 0)), float(num("density", 1.0)))
                    x, _ = draw(row[generator], spec)
                    meta = {"source": row["source"], "domain": row["domain"], "outlier_extremity": num("outlier_extremity", 1.0)}
                    fp = P.fingerprint(np.asarray(x, dtype=np.float64), int(num("k_target", 2)), np.random.default_rng(seed), 4, meta)
                    out.append({k: float(v) for k, v in fp.items()})
                except (KeyError, ValueError, np.linalg.LinAlgError):
                    out.append(None)
            yield pd.DataFrame({"task": frame["task"], "features": out})

    spread = tasks.repartition(4 * tasks.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(read, "task long, features map<string, double>")


def router_history(spark: SparkSession, folder: str, most: int = MAX_TASKS, stand_ins: Mapping[str, str] = STAND_INS) -> History:
    """(features, score of each algorithm) of past tasks: mean `ari` of the current results by task, and the task's fingerprint.

    A task is told by `KEY`, its other parameters are those of its first draw. A dataset
    that is a generator is drawn by it, another by the one that stands in for its
    domain. The `most` tasks with the most algorithms are kept, a bounded sample.
    """
    rest = [c for c in TASK if c not in KEY]
    scored = runs(spark, folder, *TASK, "ari").where("ari is not null").groupBy(*KEY, "algo").agg(F.avg("ari").alias("ari"), F.min(F.struct(*rest)).alias("draw"))
    tasks = scored.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("algo", "ari")))).alias("scores"), F.min("draw").alias("draw"))
    tasks = tasks.select(*KEY, "draw.*", "scores", F.xxhash64(*KEY).alias("task"))
    kept = stage(tasks.orderBy(F.desc(F.size("scores")), "task").limit(most), "tasks")
    listed = table(spark, folder, "dataset_metadata").select(F.col("name").alias("dataset"), "source", "domain")
    known = F.col("dataset").isin(*GENERATORS)
    by_domain = F.create_map(*[F.lit(v) for pair in stand_ins.items() for v in pair])
    drawn = kept.drop("scores").join(listed, "dataset", "left").withColumn("generator", F.when(known, F.col("dataset")).otherwise(F.coalesce(by_domain[F.col("domain")], F.lit(OTHERWISE))))
    held = kept.select("task", "scores").join(task_history(drawn), "task").where("features is not null").orderBy("task").collect()  # `most` rows at most
    return [(dict(r["features"]), dict(r["scores"])) for r in held]


def routed(history: Sequence, features: Mapping[str, float], version: int) -> str | None:
    """The algorithm that the given version of the router would ask for a task with these features."""
    from pointloom.operators.clustering import routers as R

    names = P.VERSIONS[version]
    if version >= 3:
        score = R.by_regression(history, names, features)
        return max(sorted(score), key=score.get) if score else None
    return R.by_rank(history, names, features)
