"""The Gaussian mixture as jobs over partitions.

Means and covariances are `k` small matrices and live on the driver; points never do.
An iteration is one pass: every task gives weight, sum and outer products of each
component and the log-likelihood, and the partials are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointloom.operators import kmeans as K


@dataclass
class Mixture:
    """Labels (`point_id`, `label`), BIC, and the log-likelihood of every round."""

    labels: DataFrame
    bic: float
    converged: bool
    trace: list[float] = field(default_factory=list)


def _log_density(x: np.ndarray, weight: np.ndarray, mu: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Log of weight times density of each component at each row."""
    n, d = x.shape
    out = np.empty((n, len(mu)))
    for j in range(len(mu)):
        chol = np.linalg.cholesky(s[j] + 1e-12 * np.eye(d))
        z = np.linalg.solve(chol, (x - mu[j]).T)
        out[:, j] = np.log(weight[j]) - 0.5 * (d * np.log(2 * np.pi) + (z * z).sum(axis=0)) - np.log(np.diag(chol)).sum()
    return out


def _norm(logp: np.ndarray) -> np.ndarray:
    m = logp.max(axis=1)
    return m + np.log(np.exp(logp - m[:, None]).sum(axis=1))


def _pass(points: DataFrame, k: int, d: int, shares) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weight, sum and outer products of each component, and the log-likelihood; `shares` gives responsibilities and log norms of rows.

    Each task centres on its own mean, so that outer products don't cancel far from zero.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, first, second, ll, at = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d)), 0.0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = K.matrix(batch.column(0))
            r, norm = shares(x)
            at = x.mean(axis=0) if at is None else at
            y = x - at
            w += r.sum(axis=0)
            first += r.T @ y
            for j in range(k):
                second[j] += (r[:, j, None] * y).T @ y
            ll += float(norm.sum())
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.float64())) for v in (w, first.ravel(), second.ravel(), at)] + [pa.array([ll])], names=["w", "f", "s", "at", "ll"])

    rows = points.select("x").mapInArrow(partial, "w array<double>, f array<double>, s array<double>, at array<double>, ll double").toLocalIterator()
    parts = [(np.array(r["w"]), np.array(r["f"]).reshape(k, d), np.array(r["s"]).reshape(k, d, d), np.array(r["at"]), r["ll"]) for r in rows]  # a row per task
    w = sum(p[0] for p in parts)
    sums = sum(f + pw[:, None] * at for pw, f, _, at, _ in parts)
    mu = sums / (w + 1e-10)[:, None]
    scatter = np.zeros((k, d, d))
    for pw, f, s, at, _ in parts:  # moved from the task's centre to the component's mean
        off = at - mu
        cross = f[:, :, None] * off[:, None, :]
        scatter += s + cross + cross.transpose(0, 2, 1) + pw[:, None, None] * off[:, :, None] * off[:, None, :]
    return w, mu, scatter, float(sum(p[4] for p in parts))


def mixture(points: DataFrame, k: int, seed: int = 0, cov: str = "full", reg: float = 1e-6, max_iter: int = 100, tol: float = 1e-3) -> Mixture:
    """EM from k-means over all points (`point_id`, `x`); `points` should be staged."""
    start = K.plus_plus(points, k, seed)
    centers = K.lloyd(points, start, 300).centers
    k, d = centers.shape
    n = points.count()

    def hard(x):
        label, _ = K.nearest_center(x, centers)
        return np.eye(k)[label], np.zeros(len(x))

    def shares_of(weight, mu, s):
        def shares(x):
            logp = _log_density(x, weight, mu, s)
            norm = _norm(logp)
            return np.exp(logp - norm[:, None]), norm

        return shares

    shares, last, trace, converged = hard, -np.inf, [], False
    w, mu, scatter, _ = _pass(points, k, d, shares)
    for _ in range(max_iter):
        if cov == "full":
            s = scatter / (w + 1e-10)[:, None, None] + reg * np.eye(d)
        elif cov == "tied":
            s = np.repeat((scatter.sum(axis=0) / n + reg * np.eye(d))[None], k, axis=0)
        else:
            s = np.array([np.diag(np.diag(scatter[j]) / (w[j] + 1e-10) + reg) for j in range(k)])
        weight, at = (w + 1e-10) / n, mu
        w, mu, scatter, ll = _pass(points, k, d, shares_of(weight, at, s))
        trace.append(ll)
        if abs(ll - last) < tol * n:
            converged = True
            break
        last = ll

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best = _log_density(K.matrix(batch.column(1)), weight, at, s).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32))], names=["point_id", "label"])

    p = {"full": k * d * (d + 1) / 2, "tied": d * (d + 1) / 2, "diag": k * d}[cov] + k * d + k - 1
    labels = points.select("point_id", "x").mapInArrow(label, "point_id long, label int")
    return Mixture(labels, -2 * ll + p * np.log(n), converged, trace)
