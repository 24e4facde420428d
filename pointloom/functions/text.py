"""Text features: weighted terms reduced to few dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.staging import stage

#: All terms: the most that the counter takes.
ALL_TERMS = 2**31 - 1


def _product(i: pa.Array, v: pa.Array, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows times a matrix; and the row, column and weight of each entry."""
    col, weight = i.flatten().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(i)), np.diff(i.offsets.to_numpy()))
    out = np.zeros((len(i), m.shape[1]))
    np.add.at(out, row, weight[:, None] * m[col])
    return out, row, col, weight


def axes(rows: DataFrame, n: int, terms: int, d: int, more: int = 10, rounds: int = 200, tol: float = 1e-9) -> np.ndarray:
    """The first `d` principal axes of `n` sparse rows (`i`: columns, `v`: values) by subspace iteration.

    A round is one pass over the rows; what reaches the driver is a number per term
    and axis, never a matrix of terms by terms. It ends when the variances along the axes stay within `tol`.
    """
    width = min(d + more, terms)
    spark = rows.sparkSession
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((terms, width)))[0]
    sums = rows.select(F.explode(F.arrays_zip("i", "v")).alias("e")).groupBy("e.i").agg(F.sum("e.v").alias("s")).toArrow()
    mean = np.zeros(terms)
    mean[sums["i"].to_numpy()] = sums["s"].to_numpy() / n
    last = None
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(q)

        def partial(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            z = np.zeros_like(sent.value)
            for batch in batches:
                y, row, col, weight = _product(batch.column(0), batch.column(1), sent.value)
                np.add.at(z, col, weight[:, None] * y[row])
            at = np.flatnonzero(z.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(z[at]), type=pa.list_(pa.float64()))], names=["t", "z"])

        parts = rows.select("i", "v").mapInArrow(partial, "t long, z array<double>").groupBy("t").agg(F.array(*[F.sum(F.col("z")[j]) for j in range(width)]).alias("z")).toArrow()
        sent.unpersist()
        z = np.zeros((terms, width))
        z[parts["t"].to_numpy()] = parts["z"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        z = z / n - np.outer(mean, mean @ q)
        value, turn = np.linalg.eigh(q.T @ z)
        value, turn = value[::-1], turn[:, ::-1]
        held = (q @ turn)[:, :d]
        if last is not None and np.abs(value[:d] - last).max() <= tol * max(value[0], 1e-300):
            break
        last = value[:d]
        q = np.linalg.qr(z @ turn)[0]
    return held * np.where(held[np.abs(held).argmax(axis=0), np.arange(held.shape[1])] < 0, -1.0, 1.0)


def text_points(docs: DataFrame, key: str, text: str, d: int = 16, vocabulary: int = ALL_TERMS, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """(`point_id`, `x`): TF-IDF of all terms of `min_df` or more documents (`vocabulary` at most) on `d` principal axes; null and empty texts are left out."""
    rows = docs.where(F.col(text).isNotNull() & (F.trim(text) != "")).select(F.col(key).alias("point_id"), F.col(text).alias("text"))
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}]+", minTokenLength=2).transform(rows)
    kept = StopWordsRemover(inputCol="words", outputCol="kept").transform(words)
    counter = CountVectorizer(inputCol="kept", outputCol="tf", vocabSize=vocabulary, minDF=min_df, maxDF=max_df).fit(kept)
    counted = counter.transform(kept)
    weighed = IDF(inputCol="tf", outputCol="w").fit(counted).transform(counted)
    w = F.unwrap_udt("w")
    sparse = stage(weighed.select("point_id", w["indices"].alias("i"), w["values"].alias("v")), "terms")
    turn = axes(sparse, sparse.count(), len(counter.vocabulary), d)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _product(batch.column(1), batch.column(2), turn)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), type=pa.list_(pa.float64()))], names=["point_id", "x"])

    kind = sparse.schema["point_id"].dataType.simpleString()
    return sparse.mapInArrow(project, f"point_id {kind}, x array<double>")
