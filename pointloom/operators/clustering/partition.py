"""Centroid, medoid, hierarchical and density kernels."""

from __future__ import annotations

import numpy as np

from pointloom.operators.clustering import kernels as U
from pointloom.operators.clustering.base import Fit, Step, register


def _k(x: np.ndarray, k: int | None, default: int = 8) -> int:
    return max(1, min(k or default, len(x)))


@register("kmeans")
def kmeans(x, k, rng, n_init=10, max_iter=300, tol=1e-4, trim=0.0, kind="em", **_):
    """Lloyd from k-means++ starts; the best of `n_init` by inertia."""
    label, c, inertia, trace = U.lloyd(x, _k(x, k), rng, n_init, max_iter, tol, trim)
    return Fit(label, {"inertia": inertia, "n_iter": len(trace)}, [Step(t, {"type": kind, "iteration": i}, {"k": len(c)}) for i, t in enumerate(trace)])


@register("kmeans_trimmed")
def kmeans_trimmed(x, k, rng, trim=0.1, **p):
    """Means without each cluster's farthest members."""
    return kmeans(x, k, rng, trim=trim, kind="trimmed_em", **p)


@register("parallel_kmeans")
def parallel_kmeans(x, k, rng, n_init=3, **p):
    """Map-reduce Lloyd; over a table of points see `operators.kmeans`, which this is one partition of."""
    return kmeans(x, k, rng, n_init=n_init, kind="mapreduce", **p)


@register("minibatch_kmeans")
def minibatch_kmeans(x, k, rng, batch=10_000, max_iter=100, n_init=3, **_):
    """Centres moved by batches with a rate of one over what each has seen."""
    best = None
    for _ in range(n_init):
        c = x[U.kpp(x, _k(x, k), rng)].copy()
        seen = np.zeros(len(c))
        for _ in range(max_iter):
            rows = x[rng.choice(len(x), min(batch, len(x)), replace=False)]
            label = U.sq_dists(rows, c).argmin(axis=1)
            n = np.bincount(label, minlength=len(c))
            target = U.means(rows, label, c)
            seen += n
            rate = np.where(seen > 0, n / np.maximum(seen, 1), 0.0)
            moved = c + rate[:, None] * (target - c)
            done = np.abs(moved - c).max() < 1e-4
            c = moved
            if done:
                break
        d = U.sq_dists(x, c)
        cost = float(d.min(axis=1).sum())
        if best is None or cost < best[1]:
            best = (d.argmin(axis=1), cost)
    return Fit(best[0], {"inertia": best[1]})


def _medoids(x, k, rng, numlocal, maxneigh, seeded, stop_on_first_reject):
    best, steps = None, []
    for run in range(numlocal):
        m = U.kpp(x, k, rng) if seeded else rng.choice(len(x), k, replace=False)
        d = np.sqrt(U.sq_dists(x, x[m]))
        cost = float(d.min(axis=1).sum())
        steps.append(Step(cost, {"type": "init", "run": run}, {"medoids": m.tolist()}))
        tries = 0
        while tries < maxneigh and len(x) > k:
            out, into = int(rng.integers(k)), int(rng.integers(len(x)))
            if into in m:
                tries += 1
                continue
            col = np.sqrt(U.sq_dists(x, x[into : into + 1])).ravel()
            trial = d.copy()
            trial[:, out] = col
            new = float(trial.min(axis=1).sum())
            better = new < cost
            steps.append(Step(new if better else cost, {"type": "swap", "out": int(m[out]), "in": into}, {"medoids": m.tolist()}, better, new - cost))
            if better:
                d, cost = trial, new
                m = m.copy()
                m[out] = into
                tries = 0
            elif stop_on_first_reject:
                break
            else:
                tries += 1
        if best is None or cost < best[1]:
            best = (d.argmin(axis=1), cost, m)
    return Fit(best[0], {"cost": best[1], "medoids": best[2].tolist()}, steps)


@register("clarans")
def clarans(x, k, rng, numlocal=3, maxneigh=30, stop_on_first_reject=True, **_):
    """Random swaps of medoids; by default a search ends with the first swap that doesn't pay."""
    return _medoids(x, _k(x, k), rng, numlocal, maxneigh, False, stop_on_first_reject)


@register("clarans_pp")
def clarans_pp(x, k, rng, numlocal=3, maxneigh=80, stop_on_first_reject=True, **_):
    """The same from k-means++ medoids."""
    return _medoids(x, _k(x, k), rng, numlocal, maxneigh, True, stop_on_first_reject)


class _Branch:
    """A node of a tree of summaries: count, sum and sum of squares of each entry, and what each stands for (nothing in a leaf)."""

    def __init__(self, d: int, room: int, leaf: bool):
        self.n, self.ls, self.ss, self.below = np.zeros(room + 1), np.zeros((room + 1, d)), np.zeros(room + 1), None if leaf else []
        self.size = 0

    def add(self, n: float, ls: np.ndarray, ss: float, below: _Branch | None = None) -> None:
        self.n[self.size], self.ls[self.size], self.ss[self.size] = n, ls, ss
        if self.below is not None:
            self.below.append(below)
        self.size += 1

    def centers(self) -> np.ndarray:
        return self.ls[: self.size] / self.n[: self.size, None]

    def halves(self) -> tuple[_Branch, _Branch]:
        """Two nodes around the entries that are farthest apart."""
        c = self.centers()
        d = U.sq_dists(c, c)
        i, j = np.unravel_index(int(d.argmax()), d.shape)
        to_first = d[i] < d[j]
        to_first[i], to_first[j] = True, False
        out = []
        for side in (True, False):
            part = _Branch(self.ls.shape[1], len(self.n) - 1, self.below is None)
            for e in np.flatnonzero(to_first == side).tolist():
                part.add(self.n[e], self.ls[e], self.ss[e], None if self.below is None else self.below[e])
            out.append(part)
        return out[0], out[1]

    def whole(self) -> tuple[float, np.ndarray, float]:
        return float(self.n[: self.size].sum()), self.ls[: self.size].sum(axis=0), float(self.ss[: self.size].sum())

    def insert(self, n: float, ls: np.ndarray, ss: float, limit: float) -> tuple[_Branch, _Branch] | None:
        """Put a row, or a summary, into the nearest one that stays within the limit, or a new one; the halves of a node that is too full."""
        i = int(((self.ls[: self.size] / self.n[: self.size, None] - ls / n) ** 2).sum(axis=1).argmin()) if self.size else -1
        if self.below is not None:
            parts = self.below[i].insert(n, ls, ss, limit)
            if parts is None:
                self.n[i] += n
                self.ls[i] += ls
                self.ss[i] += ss
                return None
            self.n[i], self.ls[i], self.ss[i] = parts[0].whole()
            self.below[i] = parts[0]
            self.add(*parts[1].whole(), parts[1])
        else:
            if i >= 0:
                count, sums, squares = self.n[i] + n, self.ls[i] + ls, self.ss[i] + ss
                if squares / count - float(sums @ sums) / (count * count) <= limit:
                    self.n[i], self.ls[i], self.ss[i] = count, sums, squares
                    return None
            self.add(n, ls, ss)
        return self.halves() if self.size == len(self.n) else None

    def leaves(self) -> list[_Branch]:
        return [self] if self.below is None else [leaf for b in self.below for leaf in b.leaves()]


class Summaries:
    """A height-balanced tree of summaries whose radius stays within `threshold`; with `most`, the threshold grows whenever there would be more."""

    def __init__(self, d: int, threshold: float, branching: int = 50, most: int | None = None):
        self.d, self.threshold, self.branching, self.most = d, threshold, branching, most
        self.root, self.count = _Branch(d, branching, True), 0

    def add(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        """Take in rows (of which n is 1) or summaries."""
        for count, sums, squares in zip(n.tolist(), ls, ss.tolist(), strict=True):
            parts = self.root.insert(count, sums, squares, self.threshold**2)
            if parts is not None:
                self.root = _Branch(self.d, self.branching, False)
                for part in parts:
                    self.root.add(*part.whole(), part)
            self.count += 1
            if self.most is not None and self.count > 2 * self.most:
                self._shrink()

    def _shrink(self) -> None:
        n, ls, ss = self.entries()
        while len(n) > self.most:
            self.threshold = self.threshold * 1.5 or 1e-6
            self.root, self.most, most = _Branch(self.d, self.branching, True), None, self.most
            self.add(n, ls, ss)
            self.most = most
            n, ls, ss = self.entries()
        self.count = len(n)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, sums and sums of squares of the leaf entries."""
        leaves = self.root.leaves()
        return tuple(np.concatenate([getattr(leaf, f)[: leaf.size] for leaf in leaves]) for f in ("n", "ls", "ss"))


def summaries(x: np.ndarray, threshold: float, branching: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, sizes) of the leaf entries of a tree over the rows of a matrix."""
    shift = x.mean(axis=0)  # squares are taken about the mean, lest they cancel
    tree = Summaries(x.shape[1], threshold, branching)
    tree.add(np.ones(len(x)), x - shift, ((x - shift) ** 2).sum(axis=1))
    n, ls, _ = tree.entries()
    return ls / n[:, None] + shift, n


@register("birch_algo")
def birch(x, k, rng, threshold=1.5, branching=50, **_):
    """A tree of mergeable summaries, then Ward over its leaf entries; the threshold shrinks until there are `k`."""
    k = _k(x, k)
    while True:
        c, n = summaries(x, threshold, branching)
        if len(c) >= k or threshold < 1e-6:
            break
        threshold *= 0.7
    part = U.ward_chain(c, k, n)
    home = U.neighbours(x, 1, c)[1][:, 0]
    return Fit(part[home], {"n_summaries": len(c), "threshold": threshold})


@register("agglomerative")
def agglomerative(x, k, rng, linkage="ward", **_):
    """Merges of the closest clusters; Ward's are found without a matrix of distances."""
    if linkage == "ward":
        return Fit(U.ward_chain(x, _k(x, k, 2)))
    return Fit(U.merge_tree(np.sqrt(U.sq_dists(x, x)), _k(x, k, 2), linkage))


@register("dbscan")
def dbscan(x, k, rng, eps=0.5, min_samples=5, **_):
    """Density clusters at a given radius."""
    return Fit(U.density_clusters(x, eps, min_samples), {"eps": eps})


@register("dbscan_auto")
def dbscan_auto(x, k, rng, min_samples=5, **_):
    """Density clusters at the radius of the knee."""
    eps = U.auto_eps(x, min_samples)
    return Fit(U.density_clusters(x, eps, min_samples), {"eps": eps})


def reachability(x: np.ndarray, min_samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, reachability in that order, place in the order of each one's predecessor): always the nearest to what was reached is next."""
    n = len(x)
    d = np.sqrt(U.sq_dists(x, x))
    core = np.partition(d, min(min_samples, n) - 1, axis=1)[:, min(min_samples, n) - 1]
    reach, from_, open_ = np.full(n, np.inf), np.full(n, -1), np.ones(n, dtype=bool)
    order = np.empty(n, dtype=int)
    for at in range(n):
        left = np.flatnonzero(open_)
        i = int(left[reach[left].argmin()])
        order[at], open_[i] = i, False
        left = left[left != i]
        new = np.maximum(core[i], d[i, left])
        closer = new < reach[left]
        reach[left[closer]] = new[closer]
        from_[left[closer]] = i
    place = np.empty(n, dtype=int)
    place[order] = np.arange(n)
    return order, reach[order], np.where(from_[order] >= 0, place[from_[order]], -1)


def _area(steep: np.ndarray, against: np.ndarray, at: int, patience: int) -> int:
    """End of the steep area that starts at `at`: no step against it, and not more than `patience` flat ones in a row."""
    end, flat = at, 0
    for i in range(at, len(steep)):
        if steep[i]:
            end, flat = i, 0
        elif against[i]:
            break
        else:
            flat += 1
            if flat > patience:
                break
    return end


def xi_valleys(r: np.ndarray, before: np.ndarray, xi: float, min_samples: int, min_size: int) -> list[tuple[int, int]]:
    """(first, last) of the valleys of a reachability plot between steep falls and steep rises, inner ones first.

    A step is steep if it changes the height by the part `xi`. Every rise is matched
    with the falls before it whose walls are higher than all in between; the wall that
    is higher by `xi` is cut to the other's height, a valley's end that was reached from
    outside is left off, and what is shorter than `min_size` is none.
    """
    r = np.append(r, np.inf)
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = r[:-1] / r[1:]
    down, up = ratio >= 1 / (1 - xi), ratio <= 1 - xi
    falling, rising = ratio > 1, ratio < 1
    falls: list[list] = []  # start, end, height of what lies between its end and here
    found: list[tuple[int, int]] = []
    at, between = 0, 0.0
    for i in np.flatnonzero(down | up).tolist():
        if i < at:
            continue
        between = max(between, float(r[at : i + 1].max()))
        falls = [[a, b, max(h, between)] for a, b, h in falls if r[a] * (1 - xi) >= between]
        if down[i]:
            end = _area(down, rising, i, min_samples)
            falls.append([i, end, 0.0])
            at, between = end + 1, float(r[end + 1]) if end + 1 < len(r) else 0.0
            continue
        end = _area(up, falling, i, min_samples)
        at, between = end + 1, float(r[end + 1]) if end + 1 < len(r) else 0.0
        inner: list[tuple[int, int]] = []
        for a, b, high in falls:
            first, last = a, end
            if r[end + 1] * (1 - xi) < high:
                continue
            if r[a] * (1 - xi) >= r[end + 1]:
                while first < b and r[first + 1] > r[end + 1]:
                    first += 1
            elif r[end + 1] * (1 - xi) >= r[a]:
                while last > i and r[last - 1] > r[a]:
                    last -= 1
            while last > first and not (r[first] > r[last] or first <= before[last] < last):
                last -= 1
            if last - first + 1 >= min_size and first <= b and last >= i:
                inner.append((first, last))
        found += inner[::-1]
    return found


@register("optics")
def optics(x, k, rng, min_samples=5, xi=0.05, min_cluster_size=None, **_):
    """Reachability order; clusters are its smallest valleys between steep falls and steep rises, all else is noise."""
    n = len(x)
    if n < 2:
        return Fit(np.full(n, -1))
    order, r, before = reachability(x, min_samples)
    label, used = np.full(n, -1), 0
    valleys = xi_valleys(r, before, xi, min_samples, min_cluster_size or min_samples)
    for first, last in valleys:
        if (label[first : last + 1] < 0).all():
            label[first : last + 1] = used
            used += 1
    out = np.empty(n, dtype=int)
    out[order] = label
    return Fit(out, {"valleys": len(valleys)}, [Step(float(np.where(np.isfinite(r), r, 0.0).mean()), {"type": "reachability"})])


def bandwidth(x: np.ndarray, rng: np.random.Generator, quantile: float = 0.2, trim: float | None = None, most: int = 500) -> float:
    """Mean distance to the neighbour at `quantile` of a sample, without the top `trim` of them."""
    s = x if len(x) <= most else x[rng.choice(len(x), most, replace=False)]
    dist = U.neighbours(s, max(2, int(quantile * len(s))))[0]
    far = dist[:, -1] if trim is None else dist.mean(axis=1)
    if trim is not None:
        below = far < np.quantile(far, 1 - trim)
        far = far[below] if below.any() else far
    return float(far.mean()) or 1.0


def _mean_shift(x: np.ndarray, bw: float, max_iter: int = 100) -> Fit:
    bins, n = np.unique(np.round(x / bw), axis=0, return_counts=True)
    seeds = bins * bw if len(bins) < len(x) else x.copy()
    weight = np.zeros(len(seeds), dtype=int)
    for i, s in enumerate(seeds):
        for _ in range(max_iter):
            near = ((x - s) ** 2).sum(axis=1) <= bw * bw
            weight[i] = near.sum()
            if not near.any():
                break
            moved = x[near].mean(axis=0)
            step = np.linalg.norm(moved - s)
            s = moved
            if step < 1e-3 * bw:
                break
        seeds[i] = s
    modes: list[np.ndarray] = []
    for i in np.argsort(-weight, kind="stable"):
        if weight[i] and all(np.linalg.norm(seeds[i] - m) >= bw for m in modes):
            modes.append(seeds[i])
    if not modes:
        return Fit(np.zeros(len(x), dtype=int), {"bandwidth": bw})
    return Fit(U.sq_dists(x, np.array(modes)).argmin(axis=1), {"bandwidth": bw, "n_modes": len(modes)})


@register("meanshift")
def meanshift(x, k, rng, quantile=0.2, **_):
    """Modes of a flat kernel from binned seeds."""
    return _mean_shift(x, bandwidth(x, rng, quantile))


@register("meanshift_robust")
def meanshift_robust(x, k, rng, quantile=0.2, trim=0.1, **_):
    """The same with a bandwidth that leaves the most distant points out."""
    return _mean_shift(x, bandwidth(x, np.random.default_rng(0), quantile, trim))
