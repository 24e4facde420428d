"""Streams of points, events and results."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointloom.operators import kmeans as K
from pointloom.operators.relational import upsert


def windowed_values(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and extremes per window; works on streams (with a watermark) and tables alike."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, late) if timed.isStreaming else timed
    return timed.groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lowest"), F.max(value).alias("highest")).select(F.col("window.start").alias("start"), by, "n", "mean", "lowest", "highest")


class OnlineKMeans:
    """Centres moved by each batch with a rate of one over what they have seen, decayed."""

    def __init__(self, centers: np.ndarray, decay: float = 1.0):
        self.centers, self.seen, self.decay = np.asarray(centers, dtype=float), np.zeros(len(centers)), decay

    def update(self, points: DataFrame) -> None:
        """Take in a batch: one pass of partial sums over it."""
        moved, n, _ = K._means(points, self.centers)
        self.seen = self.seen * self.decay + n
        rate = np.where(self.seen > 0, n / np.maximum(self.seen, 1e-12), 0.0)
        self.centers = self.centers + rate[:, None] * (moved - self.centers)


def online_kmeans(points: DataFrame, model: OnlineKMeans, checkpoint: str) -> StreamingQuery:
    """Feed a stream of points (`point_id`, `x`) to a model until what is there is used up."""
    return points.writeStream.foreachBatch(lambda batch, _: model.update(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batches(results: DataFrame, target: str, keys: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Merge a stream of results into a table by `keys`; each batch writes a new version of the table next to the old one, so a repeated batch changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(keys))
        if number > 0:
            fresh = upsert(spark.read.parquet(f"{target}/v{number - 1}"), fresh, keys)
        fresh.write.mode("overwrite").parquet(f"{target}/v{number}")

    return results.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def plateau_steps(steps: DataFrame, least: int = 3, below: float = 1e-4) -> DataFrame:
    """(`run_id`, `step_idx`): steps at which the last `least` changes of cost are all below `below`, found as a stream of steps arrives.

    The state of a run is its last changes, so it is as small for a long run.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def flat(key, frames, state):
        recent = list(state.get[0]) if state.exists else []
        for frame in frames:
            hits = []
            for r in frame.sort_values("step_idx").itertuples():
                recent = [*recent, abs(r.delta_cost) if r.delta_cost == r.delta_cost else float("inf")][-least:]
                if len(recent) == least and max(recent) < below:
                    hits.append((key[0], int(r.step_idx)))
            if hits:
                yield pd.DataFrame(hits, columns=["run_id", "step_idx"])
        state.update((recent,))

    plain = steps.select("run_id", "step_idx", F.col("delta_cost").cast("double").alias("delta_cost"))
    return plain.groupBy("run_id").applyInPandasWithState(flat, "run_id string, step_idx int", "recent array<double>", "append", GroupStateTimeout.NoTimeout)
