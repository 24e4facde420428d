"""Kernels on graphs of neighbours."""

from __future__ import annotations

import numpy as np

from pointloom.operators.clustering import kernels as U
from pointloom.operators.clustering.base import Fit, Step, register


@register("spectral")
def spectral(x, k, rng, k_nn=10, most=None, **_):
    """k-means of the lowest Laplacian vectors of the neighbour graph of all points, or of `most` landmarks."""
    k = max(1, min(k or 8, len(x) - 1))
    e = U.embed(x, k, min(k_nn, len(x) - 1), rng, most, drop_trivial=False)
    return Fit(U.lloyd(U.unit_rows(e), k, rng)[0])


@register("chameleon")
def chameleon(x, k, rng, k_nn=15, **_):
    """Micro-clusters merged by how near they lie and how strongly the neighbour graph ties them."""
    n = len(x)
    k = max(1, min(k or 8, n))
    dist, index = U.neighbours(x, min(k_nn, n - 1))
    micro = max(k, min(120, 8 * k, n))
    label, c, inertia, _ = U.lloyd(x, micro, rng, n_init=1)
    rows = np.repeat(np.arange(n), index.shape[1])
    tie = np.zeros((len(c), len(c)))
    np.add.at(tie, (label[rows], label[index.ravel()]), 1.0 / (1.0 + dist.ravel()))
    tie = np.maximum(tie, tie.T)
    d = np.sqrt(U.sq_dists(c, c))
    mid = float(np.median(d[d > 0])) if (d > 0).any() else 1.0
    score = np.exp(-d / mid) * np.log1p(tie)
    part = U.merge_tree(1.0 / (1.0 + score), k, "average")
    steps = [Step(float(dist.mean()), {"type": "knn_graph", "k": int(index.shape[1])}), Step(inertia, {"type": "partition", "micro": len(c)}), Step(float(score.mean()), {"type": "merge", "k": k})]
    return Fit(part[label], {"n_micro": len(c)}, steps)


@register("mri")
def mri(x, k, rng, echoes=4, k_nn=15, **_):
    """Points read as spins: relaxation by local density and anisotropy, signals at several echoes, k-means of them."""
    n = len(x)
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    steps = [Step(float(s[0]), {"type": "b0_alignment"})]
    along = c @ vt[0] / max(float(np.abs(c @ vt[0]).max()), 1e-12)
    dist, index = U.neighbours(x, min(k_nn, n - 1))
    density = 1.0 / (dist.mean(axis=1) + 1e-12)
    density = (density - density.min()) / max(np.ptp(density), 1e-12)
    local = x[index] - x[index].mean(axis=1, keepdims=True)
    value = np.linalg.eigvalsh(np.einsum("nki,nkj->nij", local, local) / index.shape[1])
    anisotropy = np.clip(1.0 - value[:, :1].ravel() / np.maximum(value[:, -1], 1e-12), 0, 1)
    steps.append(Step(float(density.mean()), {"type": "environment_probe"}))
    t1, t2 = 0.3 + 1.7 * (1 - density), 0.05 + 0.45 * (1 - anisotropy)
    steps.append(Step(float(t1.mean()), {"type": "rf_excitation"}))
    phase = np.pi * along
    blocks = [U.zscore(c), np.column_stack([np.cos(phase), np.sin(phase)])]
    relax = []
    for e in range(1, echoes + 1):
        te = 0.1 * e
        signal = (1 - np.exp(-1.0 / t1)) * np.exp(-te / t2)
        relax += [signal * np.cos(phase * e), signal * np.sin(phase * e)]
        steps.append(Step(float(signal.mean()), {"type": "echo", "te": te}))
    blocks.append(np.column_stack(relax))
    weight = (1.0, 0.5, 0.5)
    features = np.hstack([w * b / max(float(np.linalg.norm(b) / np.sqrt(n)), 1e-12) for w, b in zip(weight, blocks, strict=True)])
    steps.append(Step(float(np.linalg.norm(features)), {"type": "signature", "dim": features.shape[1]}))
    label, _, inertia, _ = U.lloyd(features, max(1, min(k or 8, n)), rng)
    steps.append(Step(inertia, {"type": "kmeans"}))
    return Fit(label, {"n_echoes": echoes}, steps)


@register("s5c")
def s5c(x, k, rng, sample=500, sparsity=5, **_):
    """Each sampled point as a sparse sum of others; spectral clusters of the coefficients; the rest by the nearest point."""
    n = len(x)
    k = max(1, min(k or 8, n))
    chosen = np.sort(rng.choice(n, min(sample, n), replace=False))
    s = U.unit_rows(x[chosen])
    steps = [Step(float(len(chosen)), {"type": "sample"})]
    m = len(s)
    coef = np.zeros((m, m))
    for i in range(m):
        rest, support = s[i].copy(), []
        for _ in range(min(sparsity, m - 1)):
            c = np.abs(s @ rest)
            c[i] = -1
            c[support] = -1
            j = int(c.argmax())
            if c[j] < 1e-9:
                break
            support.append(j)
            w, *_ = np.linalg.lstsq(s[support].T, s[i], rcond=None)
            rest = s[i] - s[support].T @ w
        if support:
            coef[i, support] = w
    a = np.abs(coef) + np.abs(coef).T
    steps.append(Step(float((a > 0).mean()), {"type": "sparse_code"}))
    _, v = U.laplacian_vectors(a, k)
    label = U.lloyd(U.unit_rows(v), k, rng)[0]
    steps.append(Step(float(k), {"type": "spectral"}))
    full = label[U.neighbours(x, 1, x[chosen])[1][:, 0]]
    full[chosen] = label
    steps.append(Step(float(n), {"type": "out_of_sample"}))
    return Fit(full, {"n_sample": m}, steps)


def modularity(w: np.ndarray | U.Links, label: np.ndarray) -> float:
    """Newman's modularity of a weighted graph without loops."""
    if isinstance(w, U.Links):
        m2 = w.w.sum()
        inside = w.w[label[w.rows] == label[w.to]].sum()
        degree = w.degree()
    else:
        m2 = w.sum()
        inside = w[label[:, None] == label[None, :]].sum()
        degree = w.sum(axis=1)
    if m2 <= 0:
        return 0.0
    deg = np.bincount(label, weights=degree)
    return float((inside - (deg**2).sum() / m2) / m2)


def louvain(w: U.Links, rng: np.random.Generator) -> np.ndarray:
    """Communities by moves of single nodes, then of communities, while modularity rises."""
    home = np.arange(w.n)
    graph = w
    while True:
        n, m2, deg = graph.n, graph.w.sum(), graph.degree()
        if m2 <= 0:
            return home
        com, total = np.arange(n), deg.copy()
        beside = [(graph.to[a:b][own], graph.w[a:b][own]) for i, (a, b) in enumerate(zip(graph.ptr[:-1], graph.ptr[1:], strict=True)) for own in [graph.to[a:b] != i]]
        moved = True
        while moved:
            moved = False
            for i in rng.permutation(n).tolist():
                to, weight = beside[i]
                if not len(to):
                    continue
                here = com[i]
                total[here] -= deg[i]
                names, at = np.unique(np.append(com[to], here), return_inverse=True)
                gain = np.bincount(at[:-1], weights=weight, minlength=len(names)) - total[names] * deg[i] / m2
                best = int(gain.argmax())
                if gain[best] > gain[at[-1]] + 1e-12:
                    com[i], moved = names[best], True
                total[com[i]] += deg[i]
        names, com = np.unique(com, return_inverse=True)
        home = com[home]
        if len(names) == n:
            return home
        graph = U.Links(len(names), com[graph.rows], com[graph.to], graph.w)


@register("louvain_knn")
def louvain_knn(x, k, rng, most=None, **_):
    """Communities of the neighbour graph, merged or split until there are `k`."""
    n = len(x)
    if n < 8:
        return Fit(U.lloyd(x, max(1, min(k or 2, n)), rng)[0])
    sd = x.std(axis=0)
    z = U.unit_rows(x) if sd.max() > 5 * max(sd[sd > 0].min(initial=1e-12), 1e-12) else x
    chosen, near = U.landmarks(z, most, rng)
    kk = int(np.clip(round(2 * np.log2(n)), 3, 15))
    w = U.knn_links(z[chosen], kk)
    label = louvain(w, rng)
    steps = [Step(-modularity(w, label), {"type": "louvain", "communities": int(label.max() + 1)})]
    while k and label.max() + 1 > k:
        small = int(np.bincount(label).argmin())
        own = label[w.rows] == small
        tie = np.bincount(label[w.to[own]], weights=w.w[own], minlength=label.max() + 1)
        tie[small] = -1
        label[label == small] = int(tie.argmax())
        label = np.unique(label, return_inverse=True)[1]
        steps.append(Step(-modularity(w, label), {"type": "merge"}))
    while k and label.max() + 1 < min(k, len(chosen)):
        big = np.flatnonzero(label == np.bincount(label).argmax())
        if len(big) < 2:
            break
        _, v = U.laplacian_vectors(w.among(big), 2)
        half = v[:, 1] > np.median(v[:, 1])
        label[big[half if half.any() and not half.all() else np.arange(len(big)) < len(big) // 2]] = label.max() + 1
        steps.append(Step(-modularity(w, label), {"type": "split"}))
    if near is not None:
        full = label[near[:, 0]]
        full[chosen] = label
        label = full
    return Fit(label, {"modularity": -steps[-1].cost}, steps)
