"""Lloyd's algorithm and its variants as jobs over partitions.

Centres are `k` rows and live on the driver; points never do. An iteration is one
pass: every batch assigns its points with one matrix product and emits a partial sum
per centre, and the partials are added up by `k` groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.staging import discard, stage


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, without going through Python lists."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def nearest_center(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre and squared distance to it; the first of equals to nine places."""
    sq = np.empty((len(x), len(centers)))
    for j, c in enumerate(centers):
        diff = x - c
        sq[:, j] = np.einsum("ij,ij->i", diff, diff)
    label = np.argmin(np.round(sq, 9), axis=1)
    return label, sq[np.arange(len(x)), label]


def assign(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """(`point_id`, `x`, `label`, `sq`): every point with its nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                label, sq = nearest_center(matrix(batch.column(1)), centers)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label.astype(np.int32)), pa.array(sq)], names=["point_id", "x", "label", "sq"])

    return points.select("point_id", "x").mapInArrow(run, "point_id long, x array<double>, label int, sq double")


def _bin(sq: np.ndarray) -> np.ndarray:
    """A bin of each squared distance that never falls with it: exponent and eight binary places, so no range need be known."""
    return (np.ascontiguousarray(sq, dtype=np.float64).view(np.int64) >> 44).astype(np.int32)


def _batches(batches: Iterator[pa.RecordBatch], centers: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column(1))
            yield batch, x, *nearest_center(x, centers)


def _cuts(points: DataFrame, centers: np.ndarray, trim: float) -> dict[int, tuple[int, int]]:
    """Of each label the bin in which its nearest share ends, and how many members of that bin are in it: one pass, a row per label and bin."""
    k = len(centers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for _, _, label, sq in _batches(batches, centers):
            key, n = np.unique(label.astype(np.int64) << 32 | _bin(sq), return_counts=True)
            for at, m in zip(key.tolist(), n.tolist(), strict=True):
                seen[at] = seen.get(at, 0) + m
        at = np.fromiter(seen, dtype=np.int64, count=len(seen))
        yield pa.RecordBatch.from_arrays([pa.array((at >> 32).astype(np.int32)), pa.array((at & 0xFFFFFFFF).astype(np.int32)), pa.array(list(seen.values()), type=pa.int64())], names=["label", "b", "n"])

    hist = points.select("point_id", "x").mapInArrow(count, "label int, b int, n long").groupBy("label", "b").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("label").orderBy("b")
    keep = F.greatest(F.lit(1), F.floor(F.sum("n").over(Window.partitionBy("label")) * F.lit(1.0 - trim)))
    upto = hist.withColumn("keep", keep).withColumn("before", F.sum("n").over(up) - F.col("n"))
    cut = upto.where((F.col("before") < F.col("keep")) & (F.col("before") + F.col("n") >= F.col("keep"))).select("label", "b", (F.col("keep") - F.col("before")).alias("more"))
    return {r["label"]: (r["b"], r["more"]) for r in cut.limit(k).collect()}  # k rows


def _means(points: DataFrame, before: np.ndarray, cuts: dict[int, tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean and size of each label's members and the inertia of all points; a label without any keeps its centre.

    Points are assigned and added up in one pass, a row per label and task. With
    `cuts`, members of farther bins are left out, and those of the bin of the cut are
    rows of their own, of which the nearest are added.
    """
    k, d = before.shape
    bound = np.full(k, np.iinfo(np.int32).max, dtype=np.int64)
    for label, (b, _) in (cuts or {}).items():
        bound[label] = b

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, squares = np.zeros((k, d)), np.zeros(k, dtype=np.int64), np.zeros(k)
        names = ["label", "s", "n", "sq", "point_id"]
        for batch, x, label, sq in _batches(batches, before):
            squares += np.bincount(label, weights=sq, minlength=k)
            at = _bin(sq)
            inner = at < bound[label]
            np.add.at(sums, label[inner], x[inner])
            counts += np.bincount(label[inner], minlength=k)
            edge = np.flatnonzero(at == bound[label])
            if len(edge):
                yield pa.RecordBatch.from_arrays([pa.array(label[edge].astype(np.int32)), pa.array(list(x[edge]), type=pa.list_(pa.float64())), pa.array(np.ones(len(edge), dtype=np.int64)), pa.array(sq[edge]), batch.column(0).take(pa.array(edge))], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(list(sums), type=pa.list_(pa.float64())), pa.array(counts), pa.array(squares), pa.nulls(k, pa.int64())], names=names)

    parts = points.select("point_id", "x").mapInArrow(add, "label int, s array<double>, n long, sq double, point_id long")
    total = [F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s"), F.sum("n").alias("n")]
    if cuts is None:
        rows = parts.groupBy("label").agg(*total, F.sum("sq").alias("sq")).collect()  # k rows
    else:
        parts = stage(parts, "parts")
        more = F.create_map(*[F.lit(v) for label, (_, m) in cuts.items() for v in (label, m)])
        near = F.row_number().over(Window.partitionBy("label").orderBy("sq", "point_id"))
        edge = parts.where("point_id is not null").withColumn("turn", near).where(F.col("turn") <= more[F.col("label")]).select("label", "s", "n", F.lit(0.0).alias("sq"))
        rows = parts.where("point_id is null").select("label", "s", "n", "sq").unionByName(edge).groupBy("label").agg(*total, F.sum("sq").alias("sq")).collect()  # k rows
        discard(parts)
    sums, sizes = np.zeros((k, d)), np.zeros(k, dtype=np.int64)
    for r in rows:
        sums[r["label"]], sizes[r["label"]] = r["s"], r["n"]
    return np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], before), sizes, float(sum(r["sq"] for r in rows))


@dataclass
class Lloyd:
    """Centres reached and, per iteration, inertia before the move and the largest shift of a centre."""

    centers: np.ndarray
    trace: list[tuple[int, float, float]] = field(default_factory=list)


def lloyd(points: DataFrame, centers: np.ndarray, max_iter: int = 100, tol: float = 1e-4, trim: float = 0.0) -> Lloyd:
    """Assign and move until the inertia or the centres change by less than `tol`; `points` should be staged or cached."""
    out = Lloyd(np.asarray(centers, dtype=np.float64))
    last = None
    for i in range(max_iter):
        cuts = _cuts(points, out.centers, trim) if trim > 0 else None
        moved, _, inertia = _means(points, out.centers, cuts)
        shift = float(np.sqrt(((moved - out.centers) ** 2).sum(axis=1)).max())
        out.trace.append((i, inertia, shift))
        out.centers = moved
        if shift < tol or (last is not None and abs(last - inertia) < tol):
            break
        last = inertia
    return out


def lowest_ids(points: DataFrame, k: int) -> np.ndarray:
    """The points with the `k` lowest ids as centres: a start without chance."""
    return np.array([r["x"] for r in points.orderBy("point_id").limit(k).collect()], dtype=np.float64)


def plus_plus(points: DataFrame, k: int, seed: int = 0, sample: int = 10_000) -> np.ndarray:
    """k-means++ over a bounded random sample of the points."""
    rows = points.orderBy(F.xxhash64("point_id", F.lit(seed))).limit(sample).select("x").collect()
    x = np.array([r["x"] for r in rows], dtype=np.float64)
    return plus_plus_rows(x, k, np.random.default_rng(seed))


def plus_plus_rows(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ over the rows of a matrix."""
    centers = [x[rng.integers(len(x))]]
    near = ((x - centers[0]) ** 2).sum(axis=1)
    for _ in range(1, min(k, len(x))):
        p = near / near.sum() if near.sum() > 0 else None
        centers.append(x[rng.choice(len(x), p=p)])
        near = np.minimum(near, ((x - centers[-1]) ** 2).sum(axis=1))
    return np.array(centers)
