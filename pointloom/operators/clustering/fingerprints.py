"""Features of a point cloud by which kernels are chosen."""

from __future__ import annotations

import math

import numpy as np

from pointloom.operators.clustering import kernels as U

BASE = ("log_n", "d", "k", "eff_dim", "conv_cv", "outlier_frac", "density_skew")
PROBES = ("probe_inertia_ratio", "probe_silhouette", "probe_size_cv", "probe_shift_ratio")
DENSITIES = ("intrinsic_dim", "density_k5", "density_k20", "density_k50")
DBSCAN = ("dbscan_clusters", "dbscan_noise")
META = ("is_real", "is_image", "log_extremity")
#: Features of each version of the learned routers.
VERSIONS = {1: BASE, 2: BASE + PROBES + DENSITIES, 3: BASE + PROBES + DENSITIES + DBSCAN, 4: BASE + PROBES + DENSITIES + DBSCAN + META}


def _sample(x: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    return x if len(x) <= most else x[rng.choice(len(x), most, replace=False)]


def base(x: np.ndarray, k: int | None, rng: np.random.Generator) -> dict[str, float]:
    """Seven features: size, dimensions, spread within clusters, outliers, evenness of density."""
    n, d = x.shape
    s = _sample(x, 1000, rng)
    share = U.principal(s, min(10, d, len(s)))[1]
    label, c, _, _ = U.lloyd(s, max(1, min(k or 3, len(s))), rng, n_init=3, max_iter=50)
    far = np.sqrt(((s - c[label]) ** 2).sum(axis=1))
    out = float((U.lof(s) > 1.5).mean()) if n >= 25 else 0.0
    dist = U.neighbours(s, min(10, len(s) - 1))[0].mean(axis=1) if len(s) > 1 else np.ones(1)
    return {
        "log_n": math.log10(max(n, 2)), "d": float(d), "k": float(k or 0), "eff_dim": float((share > 0.01).sum()), "conv_cv": float(far.std() / max(far.mean(), 1e-12)),
        "outlier_frac": out, "density_skew": float(dist.std() / max(dist.mean(), 1e-12)),
    }


def probes(x: np.ndarray, k: int | None, rng: np.random.Generator) -> dict[str, float]:
    """What three rounds of k-means on a sample show."""
    s = _sample(x, 500, rng)
    k = max(2, min(k or 3, len(s) - 1))
    c0 = s[U.kpp(s, k, rng)]
    shifts, c = [], c0
    for _ in range(3):
        label = U.sq_dists(s, c).argmin(axis=1)
        new = U.means(s, label, c)
        shifts.append(float(np.linalg.norm(new - c)))
        c = new
    first, last = U.sq_dists(s, c0).min(axis=1).sum(), U.sq_dists(s, c).min(axis=1).sum()
    n = np.bincount(label, minlength=k)
    sil = U.silhouette(s, label, 300, rng)
    return {
        "probe_inertia_ratio": float(last / max(first, 1e-12)), "probe_silhouette": 0.0 if np.isnan(sil) else sil, "probe_size_cv": float(n.std() / max(n.mean(), 1e-12)), "probe_shift_ratio": shifts[-1] / max(shifts[0], 1e-12),
    }


def densities(x: np.ndarray, rng: np.random.Generator) -> dict[str, float]:
    """Dimension by how neighbour distances grow, and mean distance to the 5th, 20th and 50th."""
    s = _sample(x, 200, rng)
    dist = U.neighbours(s, min(50, len(s) - 1))[0]
    t1, t5 = dist[:, 0], dist[:, min(4, dist.shape[1] - 1)]
    ok = (t1 > 0) & (t5 > t1)
    grow = float(np.log(t5[ok] / t1[ok]).mean()) if ok.any() else 0.0
    return {"intrinsic_dim": 4.0 / grow if grow > 0 else float(x.shape[1]), **{f"density_k{j}": float(dist[:, min(j, dist.shape[1]) - 1].mean()) for j in (5, 20, 50)}}


def dbscan_probe(x: np.ndarray, rng: np.random.Generator) -> dict[str, float]:
    """Clusters and noise at the median distance to the fifth neighbour."""
    s = _sample(x, 500, rng)
    eps = float(np.median(U.neighbours(s, min(5, len(s) - 1))[0][:, -1])) or 1e-9
    label = U.density_clusters(s, eps, 5)
    return {"dbscan_clusters": float(label.max() + 1), "dbscan_noise": float((label < 0).mean())}


def fingerprint(x: np.ndarray, k: int | None, rng: np.random.Generator, version: int = 1, meta: dict | None = None) -> dict[str, float]:
    """The features of a router version; `meta` describes the dataset if it is known."""
    fp = base(x, k, rng)
    if version >= 2:
        fp |= probes(x, k, rng) | densities(x, rng)
    if version >= 3:
        fp |= dbscan_probe(x, rng)
    if version >= 4:
        m = meta or {}
        fp |= {"is_real": float(m.get("source", "synthetic") != "synthetic"), "is_image": float(m.get("domain") == "image"), "log_extremity": math.log(float(m.get("outlier_extremity", 1.0)) + 1)}
    return {f: fp[f] for f in VERSIONS[version]}


def eigengap(x: np.ndarray, k: int, rng: np.random.Generator) -> float:
    """Relative gap before the k-th eigenvalue of the Laplacian of a sample's neighbour graph."""
    s = _sample(x, 500, rng)
    value, _ = U.laplacian_vectors(U.knn_affinity(s, min(10, len(s) - 1)), min(k + 1, len(s)))
    return float((value[min(k, len(value) - 1)] - value[k - 1]) / max(value[min(k, len(value) - 1)], 1e-12)) if k >= 1 and len(value) > 1 else 0.0


def convexity(x: np.ndarray, label: np.ndarray) -> float:
    """From the relative spread of distances to a cluster's centroid: 1 is round, 0 is not."""
    cvs = []
    for c in np.unique(label[label >= 0]):
        far = np.linalg.norm(x[label == c] - x[label == c].mean(axis=0), axis=1)
        if len(far) > 1 and far.mean() > 1e-12:
            cvs.append(far.std() / far.mean())
    return float(np.clip(1.2 - 2 * np.mean(cvs), 0, 1)) if cvs else 1.0
