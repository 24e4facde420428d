"""Small regression trees, boosted or bagged, for the routers."""

from __future__ import annotations

import numpy as np


def _grow(x, y, depth, least, features, rng):
    if depth == 0 or len(y) < 2 * least or np.ptp(y) < 1e-12:
        return float(y.mean())
    best = None
    for f in features(rng):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        s, n = np.cumsum(t)[:-1], np.arange(1, len(t))
        gain = s**2 / n + (t.sum() - s) ** 2 / (len(t) - n)
        gain[(v[1:] <= v[:-1]) | (n < least) | (len(t) - n < least)] = -np.inf
        i = int(gain.argmax()) if len(gain) else 0
        if len(gain) and np.isfinite(gain[i]) and (best is None or gain[i] > best[0]):
            best = (gain[i], f, (v[i] + v[i + 1]) / 2)
    if best is None:
        return float(y.mean())
    _, f, cut = best
    left = x[:, f] <= cut
    return f, cut, _grow(x[left], y[left], depth - 1, least, features, rng), _grow(x[~left], y[~left], depth - 1, least, features, rng)


def _read(tree, x):
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, a, b = tree
    left = x[:, f] <= cut
    out = np.empty(len(x))
    out[left], out[~left] = _read(a, x[left]), _read(b, x[~left])
    return out


class Boosted:
    """Gradient boosting of squared error."""

    def __init__(self, n_trees: int = 40, depth: int = 3, rate: float = 0.1):
        self.n_trees, self.depth, self.rate = n_trees, depth, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Fit to rows and targets."""
        rng = np.random.default_rng(0)
        self.base, self.trees = float(y.mean()), []
        rest = y - self.base
        for _ in range(self.n_trees):
            tree = _grow(x, rest, self.depth, 1, lambda r: range(x.shape[1]), rng)
            self.trees.append(tree)
            rest = rest - self.rate * _read(tree, x)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Values of rows."""
        return self.base + self.rate * sum(_read(t, x) for t in self.trees)


class Forest:
    """Bagged trees on random features; with 0/1 targets the mean is a probability."""

    def __init__(self, n_trees: int = 50, depth: int = 4):
        self.n_trees, self.depth = n_trees, depth

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        """Fit to rows and targets."""
        rng = np.random.default_rng(0)
        m = max(1, int(np.sqrt(x.shape[1])))
        self.trees = []
        for _ in range(self.n_trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(_grow(x[rows], y[rows].astype(float), self.depth, 1, lambda r: r.choice(x.shape[1], m, replace=False), rng))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Values of rows."""
        return np.mean([_read(t, x) for t in self.trees], axis=0)
