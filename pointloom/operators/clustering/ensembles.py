"""Kernels that let several others vote."""

from __future__ import annotations

import numpy as np

from pointloom.operators.clustering import kernels as U
from pointloom.operators.clustering.base import REGISTRY, Fit, Step, register


def vote(aligned: list[np.ndarray], weights: list[float] | None = None) -> np.ndarray:
    """Label with most votes, or weight, of each point: noise counts only if all say so, the first of equals wins."""
    said = np.array(aligned)
    rows = np.arange(said.shape[1])
    tally = np.zeros((said.shape[1], max(int(said.max(initial=-1)), 0) + 1))
    for labels, w in zip(said, weights or [1.0] * len(aligned), strict=True):
        known = labels >= 0
        tally[rows[known], labels[known]] += w
    score = np.where(said >= 0, tally[rows, said], -np.inf)
    best = score.argmax(axis=0)
    return np.where((said >= 0).any(axis=0), said[best, rows], -1)


def _bases(x, k, rng, base, base_params):
    found = [REGISTRY[b](x, k, rng, **(base_params or {}).get(b, {})).labels for b in base]
    return [found[0]] + [U.align(found[0], f) for f in found[1:]]


@register("consensus")
def consensus(x, k, rng, base=("kmeans", "agglomerative", "gmm"), base_params=None, **_):
    """Majority of aligned labellings."""
    return Fit(vote(_bases(x, k, rng, base, base_params)), {"base": list(base)})


@register("pwcc")
def pwcc(x, k, rng, base=("kmeans", "agglomerative", "gmm"), base_params=None, **_):
    """The same with each labelling weighted by how often it agrees with the unweighted vote."""
    aligned = _bases(x, k, rng, base, base_params)
    plain = vote(aligned)
    known = plain >= 0
    w = [float((a[known] == plain[known]).mean()) if known.any() else 1.0 for a in aligned]
    total = sum(w) or 1.0
    w = [v / total for v in w]
    steps = [Step(-v, {"type": "run_base", "algo": b}) for b, v in zip(base, w, strict=True)] + [Step(-max(w), {"type": "weighted_vote"})]
    return Fit(vote(aligned, w), {"weights": w, "base": list(base)}, steps)


@register("pwcc_diverse")
def pwcc_diverse(x, k, rng, **p):
    """Weighted vote of k-means, spectral clustering and a Gaussian mixture."""
    return pwcc(x, k, rng, **{"base": ("kmeans", "spectral", "gmm")} | p)
