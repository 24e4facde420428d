"""Kernels that choose another by what it did on past tasks or does on a sample.

History is a bounded table of tasks: a list of (features by name, score by
algorithm), as `plans.history.router_history` makes from results. Without any the
routers fall back to a fixed kernel.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence

import numpy as np

from pointloom.operators.clustering import fingerprints as P
from pointloom.operators.clustering import kernels as U
from pointloom.operators.clustering.adaptive import _delegate
from pointloom.operators.clustering.base import REGISTRY, register
from pointloom.operators.clustering.trees import Boosted, Forest

History = Sequence[tuple[dict[str, float], dict[str, float]]]
FALLBACK = "pwcc_diverse"
#: Parts of the past tasks of which each is foretold from the others.
FOLDS = 5
PROBED = ("kmeans", "gmm", "spectral", "agglomerative", "dbscan_auto")


def _table(history: History, names: Sequence[str], fp: dict[str, float]):
    x = np.array([[h.get(f, 0.0) for f in names] for h, _ in history])
    mu, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    return (x - mu) / sd, (np.array([fp[f] for f in names]) - mu) / sd


def nearest_tasks(history: History, names, fp, k=5, leave_one_out=True) -> list[tuple[float, int]]:
    """(distance, index) of the `k` nearest past tasks; the task itself (distance below 1e-6) can be left out."""
    x, q = _table(history, names, fp)
    d = np.linalg.norm(x - q, axis=1)
    order = [i for i in np.argsort(d, kind="stable") if not (leave_one_out and d[i] < 1e-6)]
    return [(float(d[i]), int(i)) for i in order[:k]]


def by_rank(history: History, names, fp, k=5) -> str | None:
    """Algorithm with the lowest mean place among the nearest tasks."""
    places: dict[str, list[int]] = {}
    for _, i in nearest_tasks(history, names, fp, k):
        for place, algo in enumerate(sorted(history[i][1], key=lambda a: (-history[i][1][a], a))):
            places.setdefault(algo, []).append(place)
    usable = {a: float(np.mean(p)) for a, p in places.items() if a in REGISTRY and not a.startswith("learned_router")}
    return min(sorted(usable), key=usable.get) if usable else None


def by_regression(history: History, names, fp, k=5, leave_one_out=False) -> dict[str, float]:
    """Score to expect of each algorithm: mean over its nearest tasks, weighted by one over the distance."""
    out = {}
    for algo in sorted({a for _, s in history for a in s}):
        own = [(f, s) for f, s in history if algo in s]
        if algo not in REGISTRY or algo.startswith("learned_router") or len(own) < 2:
            continue
        near = nearest_tasks(own, names, fp, k, leave_one_out)
        w = [1.0 / max(d, 1e-9) for d, _ in near]
        if w:
            out[algo] = sum(wi * own[i][1][algo] for wi, (_, i) in zip(w, near, strict=True)) / sum(w)
    return out


def _knn_router(version):
    def kernel(x, k, rng, history: History = (), meta=None, **_):
        if not history:
            return _delegate(FALLBACK, x, k, rng, "no_training_data")
        fp = P.fingerprint(x, k, rng, version, meta)
        return _delegate(by_rank(history, P.VERSIONS[version], fp) or FALLBACK, x, k, rng, "nearest tasks")

    return kernel


register("learned_router")(_knn_router(1))
register("learned_router_v2")(_knn_router(2))


def _pick_v3(x, k, rng, history, meta):
    fp = P.fingerprint(x, k, rng, 3, meta)
    score = by_regression(history, P.VERSIONS[3], fp)
    if score:
        order = sorted(score, key=lambda a: (-score[a], a))
        return order[0], score[order[0]] - score[order[1]] if len(order) > 1 else 1.0
    return by_rank(history, P.VERSIONS[3], fp) or FALLBACK, 0.0


@register("learned_router_v3")
def learned_router_v3(x, k, rng, history: History = (), meta=None, **_):
    """Highest score by neighbour regression."""
    if not history:
        return _delegate(FALLBACK, x, k, rng, "no_training_data")
    return _delegate(_pick_v3(x, k, rng, history, meta)[0], x, k, rng, "regression")


def _boosted_models(history, names):
    models = {}
    for algo in sorted({a for _, s in history for a in s}):
        own = [(f, s[algo]) for f, s in history if algo in s]
        if algo in REGISTRY and not algo.startswith("learned_router") and len(own) >= 5:
            models[algo] = Boosted().fit(np.array([[f.get(n, 0.0) for n in names] for f, _ in own]), np.array([s for _, s in own]))
    return models


def _boosted(history, version, fp):
    names = P.VERSIONS[version]
    return {a: float(m.predict(np.array([[fp[n] for n in names]]))[0]) for a, m in _boosted_models(history, names).items()}


def _pick_v4(x, k, rng, history, meta):
    pick, gap = _pick_v3(x, k, rng, history, meta)
    if gap > 0.05:
        return pick
    score = _boosted(history, 4, P.fingerprint(x, k, rng, 4, meta))
    return max(sorted(score), key=score.get) if score else pick


@register("learned_router_v4")
def learned_router_v4(x, k, rng, history: History = (), meta=None, **_):
    """Boosted trees per algorithm, unless version 3 is sure."""
    if not history:
        return _delegate(FALLBACK, x, k, rng, "no_training_data")
    return _delegate(_pick_v4(x, k, rng, history, meta), x, k, rng, "boosted")


@register("learned_router_v5")
def learned_router_v5(x, k, rng, history: History = (), meta=None, **_):
    """A forest that says whether version 4 or version 3 chooses better, learned on the past tasks themselves."""
    if not history:
        return _delegate(FALLBACK, x, k, rng, "no_training_data")
    names, wide = P.VERSIONS[3], P.VERSIONS[4]
    rows, better = [], []
    for fold in range(min(FOLDS, len(history))):  # what either version says of tasks that it hasn't seen
        rest = [h for j, h in enumerate(history) if j % FOLDS != fold]
        models = _boosted_models(rest, wide)
        for f, s in history[fold::FOLDS]:
            full = {n: f.get(n, 0.0) for n in wide}
            a = by_regression(rest, names, full)
            b = {algo: float(m.predict(np.array([[full[n] for n in wide]]))[0]) for algo, m in models.items()}
            if a and b:
                pa, pb = max(sorted(a), key=a.get), max(sorted(b), key=b.get)
                if pa in s and pb in s:
                    rows.append([full[n] for n in names])
                    better.append(float(s[pb] > s[pa]))
    use4 = False
    if len(set(better)) > 1:
        fp = P.fingerprint(x, k, rng, 3, meta)
        use4 = Forest().fit(np.array(rows), np.array(better)).predict(np.array([[fp[n] for n in names]]))[0] > 0.5
    pick = _pick_v4(x, k, rng, history, meta) if use4 else _pick_v3(x, k, rng, history, meta)[0]
    return _delegate(pick, x, k, rng, "stacked", {"used_v4": bool(use4)})


def probe_metrics(x: np.ndarray, label: np.ndarray, purity: bool = True, most: int = 2000) -> dict[str, float]:
    """Silhouette, Calinski-Harabasz, inverse Davies-Bouldin and, if asked for, neighbour purity of a labelling, noise aside."""
    keep = label >= 0
    s, code = x[keep], np.unique(label[keep], return_inverse=True)[1] if keep.any() else np.empty(0, int)
    k = int(code.max() + 1) if len(code) else 0
    nan = float("nan")
    if len(s) < 3 or k < 2 or k >= len(s):
        return {"silhouette": nan, "calinski_harabasz": nan, "db_inverse": nan, "purity": nan}
    c = np.array([s[code == j].mean(axis=0) for j in range(k)])
    n = np.bincount(code)
    sq = ((s - c[code]) ** 2).sum(axis=1)
    between = float((n * ((c - s.mean(axis=0)) ** 2).sum(axis=1)).sum())
    spread = np.array([np.sqrt(sq[code == j]).mean() for j in range(k)])
    d = np.sqrt(U.sq_dists(c, c)) + np.diag(np.full(k, np.inf))
    db = float(((spread[:, None] + spread[None, :]) / np.maximum(d, 1e-12)).max(axis=1).mean())
    near = U.neighbours(x, max(3, min(10, len(x) // 20)))[1] if purity else None
    pure = float((label[near[keep]] == label[keep][:, None]).mean()) if purity else nan
    return {"silhouette": U.silhouette(x, label, most), "calinski_harabasz": between / (k - 1) / max(sq.sum() / (len(s) - k), 1e-12), "db_inverse": 1 / (1 + db), "purity": pure}


def aggregate(scores: dict[str, dict[str, float]], weights: dict[str, float]) -> dict[str, float]:
    """Weighted mean of metrics scaled to 0..1 across candidates; missing ones are left out with their weight."""
    out = {}
    scaled: dict[str, dict[str, float]] = {a: {} for a in scores}
    for m in weights:
        known = {a: s[m] for a, s in scores.items() if m in s and not math.isnan(s[m])}
        if known:
            lo, hi = min(known.values()), max(known.values())
            for a, v in known.items():
                scaled[a][m] = 1.0 if hi - lo < 1e-12 else (v - lo) / (hi - lo)
    for a, s in scaled.items():
        w = sum(weights[m] for m in s)
        out[a] = sum(weights[m] * v for m, v in s.items()) / w if w else float("nan")
    return out


def _probe(x, k, rng):
    m = min(200, max(50, int(0.3 * len(x))))
    s = x[np.sort(rng.choice(len(x), min(m, len(x)), replace=False))]
    found = {}
    for name in PROBED:
        began = time.perf_counter()
        label = REGISTRY[name](s, k, rng).labels
        found[name] = probe_metrics(s, label) | {"cost_inv": 1 / (1 + time.perf_counter() - began)}
    return found


def _fallback(x, k, rng, history, meta, why):
    return _delegate(_pick_v3(x, k, rng, history, meta)[0] if history else FALLBACK, x, k, rng, why)


@register("learned_router_v6")
def learned_router_v6(x, k, rng, history: History = (), meta=None, **_):
    """Best silhouette of five kernels on a sample; version 3 for few points or if none separates."""
    if len(x) < 50:
        return _fallback(x, k, rng, history, meta, "few points")
    score = {a: np.nan_to_num(s["silhouette"], nan=-1.0) for a, s in _probe(x, k, rng).items()}
    best = max(score, key=score.get)
    return _delegate(best, x, k, rng, "probe") if score[best] >= 0.05 else _fallback(x, k, rng, history, meta, "no separation")


def _aggregated(weights, hint):
    def kernel(x, k, rng, history: History = (), meta=None, **_):
        if len(x) < 50:
            return _fallback(x, k, rng, history, meta, "few points")
        score = {a: v for a, v in aggregate(_probe(x, k, rng), weights).items() if not math.isnan(v)}
        if not score:
            return _fallback(x, k, rng, history, meta, "no metrics")
        best = max(sorted(score), key=score.get)
        if score[best] < 0.10:
            return _fallback(x, k, rng, history, meta, "no separation")
        if hint and history and score.get(_pick_v3(x, k, rng, history, meta)[0], 1.0) < 0.30 and score[best] < 0.30:
            return _fallback(x, k, rng, history, meta, "hint")
        return _delegate(best, x, k, rng, "probe", {"scores": score})

    return kernel


register("learned_router_v6b")(_aggregated({"silhouette": 1.0, "calinski_harabasz": 1.0, "db_inverse": 1.0, "purity": 1.0}, True))
register("learned_router_v6c")(_aggregated({"silhouette": 0.20, "calinski_harabasz": 0.15, "db_inverse": 0.15, "purity": 0.30, "cost_inv": 0.20}, False))


@register("learned_router_v7")
def learned_router_v7(x, k, rng, history: History = (), meta=None, margin=0.02, **_):
    """A forest on recorded scores of versions 3 and 6 that says which of the two to ask."""
    if not history:
        return _delegate(FALLBACK, x, k, rng, "no_training_data")
    names = P.VERSIONS[3]
    own = [(f, s["learned_router_v6"] > s["learned_router_v3"] + margin) for f, s in history if "learned_router_v6" in s and "learned_router_v3" in s]
    use6 = False
    if len({b for _, b in own}) > 1:
        fp = P.fingerprint(x, k, rng, 3, meta)
        model = Forest().fit(np.array([[f.get(n, 0.0) for n in names] for f, _ in own]), np.array([float(b) for _, b in own]))
        use6 = model.predict(np.array([[fp[n] for n in names]]))[0] > 0.5
    return REGISTRY["learned_router_v6" if use6 else "learned_router_v3"](x, k, rng, history=history, meta=meta)
