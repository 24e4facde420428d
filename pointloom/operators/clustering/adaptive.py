"""Kernels that look at the data before they choose how to cluster it."""

from __future__ import annotations

import math

import numpy as np

from pointloom.operators.clustering import fingerprints as P
from pointloom.operators.clustering import graph
from pointloom.operators.clustering import kernels as U
from pointloom.operators.clustering.base import REGISTRY, Fit, Step, register
from pointloom.operators.clustering.mixtures import gaussian


def _embedding(x, k, rng, most, anchors):
    n = len(x)
    kk = max(10, math.isqrt(n) // 2)
    m = min(anchors, n) if n > most else n
    return U.embed(x, max(2, k), min(kk, m - 1), rng, m)


@register("aura")
def aura(x, k, rng, **_):
    """Laplacian embedding (over anchors beyond 200 points) and a full Gaussian mixture, started anew up to three times."""
    k = max(1, min(k or 3, len(x)))
    e = _embedding(x, k, rng, 200, max(100, 2 * math.isqrt(len(x))))
    steps = [Step(float(e.std()), {"type": "embedding", "dim": e.shape[1]})]
    for attempt in range(3):
        r, ll, bic, ok, _ = gaussian(U.zscore(e), k, rng, "full", 1e-4)
        label = r.argmax(axis=1)
        steps.append(Step(-ll, {"type": "gmm", "attempt": attempt}))
        if len(np.unique(label)) == k:
            break
    return Fit(label, {"bic": bic, "converged": ok}, steps)


@register("aura_v2")
def aura_v2(x, k, rng, **_):
    """Embedding in deviations; trimmed k-means, and a tied mixture if there are outliers; the silhouette decides."""
    k = max(1, min(k or 3, len(x)))
    e = U.zscore(_embedding(x, k, rng, 1000, 1000))
    out = float((U.lof(x[rng.choice(len(x), min(len(x), 1000), replace=False)]) > 1.5).mean()) if len(x) >= 25 else 0.0
    options = {"trimmed": U.lloyd(e, k, rng, n_init=5, trim=min(0.1, 2 * out))[0]}
    if out > 0.05:
        options["tied"] = gaussian(e, k, rng, "tied", 1e-4)[0].argmax(axis=1)
    score = {name: np.nan_to_num(U.silhouette(e, label, rng=rng), nan=-1.0) for name, label in options.items()}
    best = max(score, key=score.get)
    return Fit(options[best], {"chosen": best, "outlier_frac": out}, [Step(-s, {"type": name}) for name, s in score.items()])


@register("aura_v3")
def aura_v3(x, k, rng, **_):
    """k-means of an embedding of rank two or more, else a mixture."""
    k = max(1, min(k or 3, len(x)))
    e = _embedding(x, k, rng, 1000, 1000)
    sd = e.std(axis=0)
    rank = int((sd > 0.1 * sd.max()).sum())
    label = U.lloyd(U.zscore(e), k, rng)[0] if rank >= 2 else gaussian(U.zscore(e), k, rng, "full", 1e-4)[0].argmax(axis=1)
    return Fit(label, {"effective_rank": rank}, [Step(float(rank), {"type": "rank"})])


def _regions(x, k, rng):
    """Density regions, and within each as many clusters as its share of `k`."""
    n = len(x)
    k = max(1, min(k or 3, n))
    label = U.density_clusters(x, U.auto_eps(x, 5), 5)
    if label.max() < 1:
        label = np.zeros(n, dtype=int)
    sizes = np.bincount(label[label >= 0])
    quota = np.maximum(1, np.round(k * sizes / sizes.sum()).astype(int))
    while quota.sum() > max(k, len(sizes)):
        quota[np.where(quota > 1, quota / sizes, -1).argmax()] -= 1
    while quota.sum() < k:
        quota[(sizes / quota).argmax()] += 1
    out, used, steps = np.full(n, -1), 0, [Step(float(len(sizes)), {"type": "regions"})]
    for c, q in enumerate(quota):
        rows = np.flatnonzero(label == c)
        if q == 1 or len(rows) < 5:
            how, part = ("single" if q == 1 else "tiny"), np.zeros(len(rows), dtype=int)
        else:
            round_ = P.convexity(x[rows], U.lloyd(x[rows], q, rng, n_init=2)[0])
            how = "kmeans" if round_ > 0.5 and len(rows) >= 5 * q else "spectral"
            part = REGISTRY[how](x[rows], int(q), rng).labels
        out[rows] = part + used
        used += int(part.max()) + 1
        steps.append(Step(float(len(rows)), {"type": "region", "how": how, "k": int(q)}))
    return Fit(U.reassign_noise(x, out), {"n_regions": len(sizes)}, steps)


@register("rapid")
def rapid(x, k, rng, **_):
    """Regions by density, clusters within them by shape, noise by the nearest point."""
    return _regions(x, k, rng)


@register("rapid_v2")
def rapid_v2(x, k, rng, share=0.1, **_):
    """The same without the points of highest outlier factor, which join the nearest cluster afterwards."""
    n = len(x)
    hold = int(n * share)
    if n < 25 or hold < max(1, 0.01 * n):
        return _regions(x, k, rng)
    out = np.argsort(-U.lof(x), kind="stable")[:hold]
    inner = np.setdiff1d(np.arange(n), out)
    fit = _regions(x[inner], k, rng)
    label = np.full(n, -1)
    label[inner] = fit.labels
    return Fit(U.reassign_noise(x, label), fit.extra | {"held_out": hold}, [Step(float(hold), {"type": "hold_out"}), *fit.steps])


@register("rapid_v3")
def rapid_v3(x, k, rng, **p):
    """Version 2 if more than a twentieth of the points are outliers, else version 1."""
    share = float((U.lof(x) > 1.5).mean()) if len(x) >= 25 else 0.0
    fit = REGISTRY["rapid_v2" if share > 0.05 else "rapid"](x, k, rng, **p)
    fit.steps.insert(0, Step(share, {"type": "router"}))
    return fit


def _delegate(name, x, k, rng, why, extra=None):
    fit = REGISTRY[name](x, k, rng)
    extra = {f"{name}.{key}" if key in (extra or {}) else key: v for key, v in fit.extra.items()} | (extra or {})
    return Fit(fit.labels, extra | {"routed_to": name}, [Step(0.0, {"type": "route", "to": name, "why": why}), *fit.steps])


def route(fp: dict[str, float]) -> str:
    """First rule: outliers, a spectral gap in few dimensions, uneven density, many dimensions, or none of these."""
    if fp["outlier_frac"] > 0.10:
        return "gmm"
    if fp["eigengap"] < 0.05 and fp["eff_dim"] < 5:
        return "spectral"
    if fp["density_skew"] > 0.5 and fp["outlier_frac"] < 0.05:
        return "dbscan_auto"
    if fp["eff_dim"] >= 10 and fp["outlier_frac"] < 0.05:
        return "birch_algo"
    return "pwcc_diverse"


def route_v2(fp: dict[str, float]) -> str:
    """Second rule: shape and communities come before density."""
    if fp["outlier_frac"] > 0.10:
        return "gmm"
    if fp["convexity"] < 0.45 or fp["modularity"] < 0.30:
        return "spectral"
    return route(fp)


def _shape(x, k, rng) -> dict[str, float]:
    fp = P.base(x, k, rng)
    kk = max(2, min(k or 3, len(x) - 1))
    s = x if len(x) <= 500 else x[rng.choice(len(x), 500, replace=False)]
    label = U.lloyd(s, kk, rng, n_init=3)[0]
    fp["eigengap"] = P.eigengap(x, kk, rng)
    fp["convexity"] = P.convexity(s, label)
    w = (U.knn_affinity(s, min(10, len(s) - 1)) > 0).astype(float)
    fp["modularity"] = graph.modularity(w, label)
    return fp


@register("meta_clusterer")
def meta_clusterer(x, k, rng, **_):
    """One kernel by the first rule."""
    fp = _shape(x, k, rng)
    return _delegate(route(fp), x, k, rng, "rule", {"fingerprint": fp})


def _probe(x, k, rng, names, most):
    s = x[np.sort(rng.choice(len(x), most, replace=False))] if len(x) > most else x
    return {name: np.nan_to_num(U.silhouette(s, REGISTRY[name](s, k, rng).labels, rng=rng), nan=-1.0) for name in names}


@register("meta_clusterer_v2")
def meta_clusterer_v2(x, k, rng, **_):
    """One kernel by the second rule; where shape is undecided a sample is clustered both ways."""
    fp = _shape(x, k, rng)
    to = route_v2(fp)
    if 0.40 <= fp["convexity"] <= 0.50:
        score = _probe(x, k, rng, ("spectral", "pwcc_diverse"), max(50, len(x) // 5))
        to = max(score, key=score.get)
    return _delegate(to, x, k, rng, "rule", {"fingerprint": fp})


@register("meta_clusterer_v3")
def meta_clusterer_v3(x, k, rng, **_):
    """Both rules; if they differ, a sample decides, the second winning ties."""
    fp = _shape(x, k, rng)
    a, b = route(fp), route_v2(fp)
    to = a
    if a != b:
        score = _probe(x, k, rng, (b, a), min(max(50, len(x) // 5), 500))
        to = a if score[a] > score[b] else b
    return _delegate(to, x, k, rng, "agreed" if a == b else "probe", {"fingerprint": fp})


@register("mutant_kmeans_meta")
def mutant_kmeans_meta(x, k, rng, most_cv=0.35, least_silhouette=0.30, **_):
    """k-means if its clusters are even and apart, else the second rule."""
    label, c, inertia, _ = U.lloyd(x, max(1, min(k or 8, len(x))), rng)
    far = np.sqrt(((x - c[label]) ** 2).sum(axis=1))
    cv = float(far.std() / max(far.mean(), 1e-12))
    sil = U.silhouette(x, label, rng=rng)
    first = Step(inertia, {"type": "kmeans", "conv_cv": cv, "silhouette": sil})
    if cv < most_cv and sil >= least_silhouette:
        return Fit(label, {"kept": "kmeans"}, [first])
    fit = REGISTRY["meta_clusterer_v2"](x, k, rng)
    fit.steps.insert(0, first)
    return fit
