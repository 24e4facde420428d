"""Measures of a clustering, against the truth or of its own shape.

Labelled points are (`point_id`, `x`, `label`), label -1 is noise. What can be a
sum over clusters is one; pairwise measures visit block by block (see `neighbors`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import vectors as V
from pointloom.operators.neighbors import BLOCK, _matrix, distances, visits


def contingency(df: DataFrame, truth: str, label: str) -> DataFrame:
    """(`a`, `b`, `n`): how often a truth and a label meet."""
    return df.groupBy(F.col(truth).alias("a"), F.col(label).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def external(df: DataFrame, truth: str, label: str) -> DataFrame:
    """One row (`ari`, `nmi`): adjusted Rand index and mutual information normalised by the mean entropy; 1 for two single-class partitions."""
    table = contingency(df, truth, label)
    n_a, n_b, n = (F.sum("n").over(Window.partitionBy(*w)).cast("double") for w in (["a"], ["b"], []))
    cells = table.select("a", "b", F.col("n").cast("double").alias("n"), n_a.alias("na"), n_b.alias("nb"), n.alias("t"))
    pairs = lambda c: c * (c - 1) / 2
    share_a = F.col("n") / F.col("na")
    share_b = F.col("n") / F.col("nb")
    sums = cells.agg(
        F.sum(pairs(F.col("n"))).alias("s"),
        F.sum(share_a * pairs(F.col("na"))).alias("sa"),
        F.sum(share_b * pairs(F.col("nb"))).alias("sb"),
        F.max("t").alias("t"),
        F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"),
        (-F.sum(share_a * F.col("na") / F.col("t") * F.log(F.col("na") / F.col("t")))).alias("ha"),
        (-F.sum(share_b * F.col("nb") / F.col("t") * F.log(F.col("nb") / F.col("t")))).alias("hb"),
    )
    expected = F.col("sa") * F.col("sb") / pairs(F.col("t"))
    most = (F.col("sa") + F.col("sb")) / 2
    half = (F.col("ha") + F.col("hb")) / 2
    return sums.select(F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"), F.when(half <= 1e-15, 1.0).otherwise(F.col("mi") / half).alias("nmi"))


def centroids(df: DataFrame, d: int) -> DataFrame:
    """(`label`, `c`, `n`): mean point and size of each label."""
    return df.groupBy("label").agg(V.mean_vector("x", d).alias("c"), F.count(F.lit(1)).alias("n"))


def to_centroid(df: DataFrame, d: int) -> DataFrame:
    """(`label`, `n`, `c`, `mean_sq`, `mean_d`, `sum_sq`, `cv`): spread of each label about its centroid."""
    c = centroids(df, d)
    joined = df.join(c.select("label", "c"), "label").withColumn("sq", V.squared_distance("x", "c"))
    return joined.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.first("c").alias("c"), F.avg("sq").alias("mean_sq"), F.avg(F.sqrt("sq")).alias("mean_d"), F.sum("sq").alias("sum_sq"), (F.stddev_pop(F.sqrt("sq")) / F.avg(F.sqrt("sq"))).alias("cv")
    )


def _pairs(spread: DataFrame) -> DataFrame:
    """Pairs of clusters with the distance of their centroids; a cluster is a row, so this is a table of at most k * k."""
    other = spread.select(F.col("label").alias("label_b"), F.col("c").alias("c_b"), F.col("mean_d").alias("mean_d_b"))
    return spread.join(other, spread["label"] != other["label_b"]).withColumn("sq", V.squared_distance("c", "c_b"))


def internal(df: DataFrame, d: int) -> DataFrame:
    """One row of centroid measures: `compactness`, `separation` (noise aside), `davies_bouldin` (noise is a cluster), `inertia`, `n_clusters_found`."""
    spread = to_centroid(df, d)
    inner = spread.where("label <> -1")
    compact = inner.agg(F.avg(F.when(F.col("n") > 1, F.col("mean_sq"))).alias("compactness"), F.sum("sum_sq").alias("inertia"), F.count(F.lit(1)).alias("n_clusters_found"))
    apart = _pairs(inner).agg(F.avg("sq").alias("separation"))
    worst = _pairs(spread).groupBy("label").agg(F.max((F.col("mean_d") + F.col("mean_d_b")) / F.sqrt("sq")).alias("w")).agg(F.avg("w").alias("davies_bouldin"))
    return compact.join(F.broadcast(apart)).join(F.broadcast(worst))  # single rows


def calinski_harabasz(df: DataFrame, d: int) -> DataFrame:
    """One row (`calinski_harabasz`): between over within spread, noise aside; null for less than two labels or as many as points."""
    inner = df.where("label <> -1")
    spread = to_centroid(inner, d)
    whole = inner.agg(V.mean_vector("x", d).alias("g"))
    sums = spread.join(F.broadcast(whole)).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * V.squared_distance("c", "g")).alias("b"), F.sum("sum_sq").alias("w"))
    value = F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))
    return sums.select(F.when((F.col("n") >= 3) & (F.col("k") >= 2) & (F.col("k") < F.col("n")) & (F.col("w") > 0), value).alias("calinski_harabasz"))


def _label_visits(df: DataFrame, block: int) -> DataFrame:
    """Blocks with their labels packed as an extra coordinate, so that a visit knows both."""
    return visits(df.select("point_id", F.concat("x", F.array(F.col("label").cast("double"))).alias("x")), None, block)


def silhouette_samples(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """(`point_id`, `silhouette`) with exact Euclidean distances; 0 for a point alone in its cluster. Every label is a cluster."""

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q_ids, q_xs, xs in zip(frame["q_ids"], frame["q_xs"], frame["xs"], strict=True):
                a, b = _matrix(q_xs), _matrix(xs)
                d = distances(a[:, :-1], b[:, :-1])
                labels, code = np.unique(b[:, -1], return_inverse=True)
                sums = d @ np.eye(len(labels))[code]
                counts = np.bincount(code, minlength=len(labels))
                rows = np.repeat(np.arange(len(a)), len(labels))
                yield pd.DataFrame({"point_id": np.asarray(q_ids)[rows], "own": a[rows, -1].astype(np.int64), "other": np.tile(labels, len(a)).astype(np.int64), "s": sums.ravel(), "n": np.tile(counts, len(a))})

    parts = _label_visits(df, block).mapInPandas(visit, "point_id long, own long, other long, s double, n long")
    means = parts.groupBy("point_id", "own", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("own") == F.col("other")
    a = F.max(F.when(own & (F.col("n") > 1), F.col("s") / (F.col("n") - 1)))
    b = F.min(F.when(~own, F.col("s") / F.col("n")))
    both = means.groupBy("point_id").agg(a.alias("a"), b.alias("b"))
    value = (F.col("b") - F.col("a")) / F.greatest("a", "b")
    return both.select("point_id", F.when(F.col("a").isNull(), 0.0).when(F.col("b").isNotNull() & (F.greatest("a", "b") > 0), value).when(F.col("b").isNotNull(), 0.0).alias("silhouette"))


def dunn(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row (`dunn`): least distance between clusters over the greatest within one, noise aside, all points taken."""

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q_xs, xs in zip(frame["q_xs"], frame["xs"], strict=True):
                a, b = _matrix(q_xs), _matrix(xs)
                d = distances(a[:, :-1], b[:, :-1])
                same = a[:, -1][:, None] == b[:, -1][None, :]
                yield pd.DataFrame({"near": [np.min(d, initial=np.inf, where=~same)], "wide": [np.max(d, initial=0.0, where=same)]})

    sums = _label_visits(df.where("label <> -1"), block).mapInPandas(visit, "near double, wide double").agg(F.min("near").alias("near"), F.max("wide").alias("wide"))
    return sums.select(F.when((F.col("wide") > 0) & (F.col("near") < float("inf")), F.col("near") / F.col("wide")).alias("dunn"))


def neighbour_purity(near: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (`purity`): share of neighbours with the point's own label, averaged over the points that are not noise."""
    own = labels.select(F.col("point_id").alias("i"), F.col("label").alias("a"))
    other = labels.select(F.col("point_id").alias("j"), F.col("label").alias("b"))
    same = near.join(own, "i").join(other, "j").where("a <> -1").groupBy("i").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("p"))
    return same.agg(F.avg("p").alias("purity"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (`modularity`) of an undirected graph given once per edge (`i`, `j`, `weight`)."""
    own = labels.select(F.col("point_id").alias("i"), F.col("label").alias("a"))
    other = labels.select(F.col("point_id").alias("j"), F.col("label").alias("b"))
    held = edges.join(own, "i").join(other, "j")
    ends = held.select(F.col("a").alias("c"), "weight", (F.col("a") == F.col("b")).alias("inside")).unionByName(held.select(F.col("b").alias("c"), "weight", (F.col("a") == F.col("b")).alias("inside")))
    each = ends.groupBy("c").agg(F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0.0)).alias("w_in"), F.sum("weight").alias("deg"))
    sums = each.agg(F.sum("w_in").alias("w_in"), F.sum(F.col("deg") * F.col("deg")).alias("sq"), F.sum("deg").alias("m2"))
    return sums.select(((F.col("w_in") - F.col("sq") / F.col("m2")) / F.col("m2")).alias("modularity"))


def shape_signature(df: DataFrame, d: int) -> DataFrame:
    """(`label`, `signature`): share of a label's points nearer to its centroid than the deviation of those distances; 1 if that is nil."""
    c = centroids(df, d)
    far = df.join(c.select("label", "c"), "label").withColumn("d", V.distance("x", "c"))
    sd = far.groupBy("label").agg(F.stddev_pop("d").alias("sd"))
    share = F.avg((F.col("d") <= F.col("sd")).cast("double"))
    return far.join(sd, "label").groupBy("label").agg(F.when(F.first("sd") <= 1e-12, 1.0).otherwise(share).alias("signature"))
