"""Numerical parts shared by the kernels; all work on a matrix of bounded size."""

from __future__ import annotations

import numpy as np


def sq_dists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * a @ b.T
    return np.maximum(d, 0.0)


def neighbours(x: np.ndarray, k: int, y: np.ndarray | None = None, step: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Distances and indices of the `k` nearest rows of `y`, or of the other rows of `x`, nearest first."""
    itself = y is None
    y = x if itself else y
    k = max(1, min(k, len(y) - itself))
    dist, index = np.empty((len(x), k)), np.empty((len(x), k), dtype=np.int64)
    for i in range(0, len(x), step):
        d = sq_dists(x[i : i + step], y)
        if itself:
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        part = np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))[:, :k]
        order = np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable")
        index[i : i + step] = np.take_along_axis(part, order, axis=1)
        dist[i : i + step] = np.sqrt(np.take_along_axis(d, index[i : i + step], axis=1))
    return dist, index


def kpp(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Rows chosen by k-means++."""
    chosen = [int(rng.integers(len(x)))]
    near = sq_dists(x, x[chosen]).ravel()
    for _ in range(1, min(k, len(x))):
        s = near.sum()
        chosen.append(int(rng.choice(len(x), p=near / s if s > 0 else None)))
        near = np.minimum(near, sq_dists(x, x[chosen[-1:]]).ravel())
    return np.array(chosen)


def means(x: np.ndarray, labels: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Mean of each label's rows; that of `before` where there are none."""
    k = len(before)
    n = np.bincount(labels, minlength=k)
    s = np.zeros_like(before)
    np.add.at(s, labels, x)
    return np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], before)


#: Numbers in the distances of all starts that are iterated together.
TOGETHER = 20_000_000


def _starts(x: np.ndarray, k: int, rng: np.random.Generator, count: int) -> np.ndarray:
    """Centres of `count` starts chosen by k-means++ side by side."""
    k, n = min(k, len(x)), len(x)
    chosen = np.empty((count, k), dtype=np.int64)
    chosen[:, 0] = rng.integers(n, size=count)
    near = sq_dists(x[chosen[:, 0]], x)
    for j in range(1, k):
        upto = near.cumsum(axis=1)
        u = rng.random(count) * upto[:, -1]
        at = np.where(upto[:, -1] > 0, (upto <= u[:, None]).sum(axis=1), rng.integers(n, size=count))
        chosen[:, j] = np.minimum(at, n - 1)
        near = np.minimum(near, sq_dists(x[chosen[:, j]], x))
    return x[chosen]


def _lloyd_side_by_side(x: np.ndarray, c: np.ndarray, max_iter: int, tol: float) -> list[tuple[np.ndarray, list[float]]]:
    """Centres and trace of each start, all being moved in the same passes until each has settled."""
    n, (count, k, d) = len(x), c.shape
    c, live = c.copy(), np.arange(count)
    traces: list[list[float]] = [[] for _ in range(count)]
    for _ in range(max_iter):
        dist = sq_dists(x, c[live].reshape(-1, d)).reshape(n, len(live), k)
        label = dist.argmin(axis=2)
        cost = np.take_along_axis(dist, label[:, :, None], axis=2)[:, :, 0].sum(axis=0)
        flat = (label + np.arange(len(live)) * k).ravel()
        size = np.bincount(flat, minlength=len(live) * k)
        sums = np.stack([np.bincount(flat, weights=np.repeat(x[:, f], len(live)), minlength=len(live) * k) for f in range(d)], axis=1)
        old = c[live].reshape(-1, d)
        new = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], old)
        shift = np.sqrt(((new - old) ** 2).sum(axis=1)).reshape(len(live), k).max(axis=1)
        c[live] = new.reshape(len(live), k, d)
        still = []
        for i, at in enumerate(live.tolist()):
            traces[at].append(float(cost[i]))
            if not (shift[i] < tol or (len(traces[at]) > 1 and abs(traces[at][-2] - traces[at][-1]) < tol)):
                still.append(at)
        live = np.array(still, dtype=np.int64)
        if not len(live):
            break
    return list(zip(c, traces, strict=True))


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, trim: float = 0.0, start: np.ndarray | None = None):
    """(labels, centres, inertia, trace of inertias): the best of `n_init` starts."""
    if start is None and trim <= 0 and n_init > 1:
        side, fits = max(1, TOGETHER // max(1, len(x) * k)), []
        for at in range(0, n_init, side):
            fits += _lloyd_side_by_side(x, _starts(x, k, rng, min(side, n_init - at)), max_iter, tol)
        best = None
        for c, trace in fits:
            d = sq_dists(x, c)
            label = d.argmin(axis=1)
            inertia = float(d[np.arange(len(x)), label].sum())
            if best is None or inertia < best[2]:
                best = (label, c, inertia, trace)
        return best
    best = None
    for _ in range(1 if start is not None else n_init):
        c = start.copy() if start is not None else x[kpp(x, k, rng)]
        trace: list[float] = []
        for _ in range(max_iter):
            d = sq_dists(x, c)
            label = d.argmin(axis=1)
            near = d[np.arange(len(x)), label]
            trace.append(float(near.sum()))
            keep = np.ones(len(x), dtype=bool)
            if trim > 0:
                for j in range(len(c)):
                    mine = np.flatnonzero(label == j)
                    drop = len(mine) - max(1, int(len(mine) * (1 - trim)))
                    if drop > 0:
                        keep[mine[np.argsort(near[mine])[-drop:]]] = False
            moved = means(x[keep], label[keep], c)
            shift = np.sqrt(((moved - c) ** 2).sum(axis=1)).max()
            c = moved
            if shift < tol or (len(trace) > 1 and abs(trace[-2] - trace[-1]) < tol):
                break
        d = sq_dists(x, c)
        label = d.argmin(axis=1)
        inertia = float(d[np.arange(len(x)), label].sum())
        if best is None or inertia < best[2]:
            best = (label, c, inertia, trace)
    return best


def merge_tree(d: np.ndarray, k: int, linkage: str = "ward", sizes: np.ndarray | None = None) -> np.ndarray:
    """Labels after merging the closest clusters until `k` are left (Lance-Williams updates of a distance matrix).

    Every cluster keeps its nearest one; merged clusters leave the matrix whenever half of it is theirs.
    """
    n = len(d)
    d = d.astype(np.float64).copy()
    if linkage == "ward":
        d = d**2
    np.fill_diagonal(d, np.inf)
    size = np.ones(n) if sizes is None else sizes.astype(float).copy()
    ids, home, dead = np.arange(n), np.arange(n), 0
    near = d.argmin(axis=1)
    best = d[np.arange(n), near]
    for _ in range(n - max(1, min(k, n))):
        i = int(best.argmin())
        j = int(near[i])
        a, b, dij = size[i], size[j], d[i, j]
        if linkage == "ward":
            new = ((a + size) * d[i] + (b + size) * d[j] - size * dij) / (a + b + size)
        elif linkage == "single":
            new = np.minimum(d[i], d[j])
        elif linkage == "complete":
            new = np.maximum(d[i], d[j])
        else:
            new = (a * d[i] + b * d[j]) / (a + b)
        new[[i, j]] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        best[j], near[j] = np.inf, -1
        size[i] = a + b
        home[home == ids[j]] = ids[i]
        dead += 1
        for s in np.flatnonzero((near == j) | (near == i)):
            near[s] = d[s].argmin()
            best[s] = d[s, near[s]]
        near[i] = d[i].argmin()
        best[i] = d[i, near[i]]
        closer = new < best
        near[closer], best[closer] = i, new[closer]
        if 2 * dead > len(ids) > 64:
            live = np.flatnonzero(near >= 0)
            place = np.full(len(ids), -1)
            place[live] = np.arange(len(live))
            d, size, ids, best, near, dead = d[np.ix_(live, live)], size[live], ids[live], best[live], place[near[live]], 0
    return np.unique(home, return_inverse=True)[1]


def ward_chain(x: np.ndarray, k: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """Labels of Ward's merges down to `k` clusters without a matrix of distances.

    A chain of nearest neighbours merges what is nearest to each other; Ward's cost of a
    merge follows from sizes and means, and the merges in order of cost are those of `merge_tree`.
    """
    n = len(x)
    c = x.astype(np.float64) - x.mean(axis=0)
    size = np.ones(n) if sizes is None else sizes.astype(float).copy()
    sq = (c * c).sum(axis=1)
    name, merges, chain = np.arange(n), [], []
    gone = np.zeros(n, dtype=bool)
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(~gone)[0])]
        while True:
            i = chain[-1]
            d = np.maximum(sq + sq[i] - 2.0 * (c @ c[i]), 0.0) * (size * size[i] / (size + size[i]))
            d[gone] = np.inf
            d[i] = np.inf
            j = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                j = chain[-2]
                break
            chain.append(j)
        merges.append((float(d[j]), int(name[i]), int(name[j])))
        del chain[-2:]
        c[j] = (size[i] * c[i] + size[j] * c[j]) / (size[i] + size[j])
        sq[j], size[j] = c[j] @ c[j], size[i] + size[j]
        gone[i] = True
        if 2 * gone.sum() > len(gone) > 64:  # merged clusters leave the matrix
            to = np.cumsum(~gone) - 1
            chain = [int(to[i]) for i in chain]
            c, sq, size, name, gone = c[~gone], sq[~gone], size[~gone], name[~gone], gone[~gone]
    first = sorted(merges, key=lambda m: m[0])[: n - max(1, min(k, n))]
    a, b = np.array([m[1] for m in first], dtype=int), np.array([m[2] for m in first], dtype=int)
    return np.unique(connected(n, a, b), return_inverse=True)[1]


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component number of each of `n` nodes."""
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        ri, rj = root(i), root(j)
        if ri != rj:
            parent[max(ri, rj)] = min(ri, rj)
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def density_clusters(x: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Labels by density; -1 for noise. A point counts itself, and a border point joins the first core point near it."""
    n = len(x)
    near = np.empty((n, n), dtype=bool)
    for i in range(0, n, 2000):
        near[i : i + 2000] = sq_dists(x[i : i + 2000], x) <= eps * eps
    core = near.sum(axis=1) >= min_samples
    label = np.full(n, -1)
    left, found = core.copy(), 0
    while left.any():
        front = np.zeros(n, dtype=bool)
        front[int(left.argmax())] = True
        while front.any():
            left &= ~front
            label[front] = found
            front = near[front].any(axis=0) & left
        found += 1
    edge = np.flatnonzero(~core)
    if found and len(edge):
        beside = near[edge] & core
        label[edge] = np.where(beside.any(axis=1), label[beside.argmax(axis=1)], -1)
    return label


def knee(values: np.ndarray) -> float:
    """The sorted value farthest from the chord; the median and a little if all are equal."""
    v = np.sort(values)
    if len(v) < 3 or v[-1] - v[0] <= 1e-12:
        return float(np.median(v)) + 1e-6
    y = (v - v[0]) / (v[-1] - v[0])
    return float(v[np.abs(y - np.linspace(0, 1, len(v))).argmax()])


def auto_eps(x: np.ndarray, min_samples: int) -> float:
    """Radius at the knee of the distances to the neighbour that would make a point a core point."""
    dist, _ = neighbours(x, max(1, min_samples - 1))
    return max(knee(dist[:, -1]), 1e-9)


def lof(x: np.ndarray, k: int = 20) -> np.ndarray:
    """Local outlier factor."""
    dist, index = neighbours(x, min(k, len(x) - 1))
    reach = np.maximum(dist, dist[:, -1][index])
    lrd = 1.0 / (reach.mean(axis=1) + 1e-10)
    return lrd[index].mean(axis=1) / lrd


def silhouette(x: np.ndarray, labels: np.ndarray, most: int = 2000, rng: np.random.Generator | None = None) -> float:
    """Mean silhouette over at most `most` rows, noise aside; NaN with less than three points or two clusters."""
    keep = np.flatnonzero(labels >= 0)
    if len(keep) > most:
        keep = (rng or np.random.default_rng(42)).choice(keep, most, replace=False)
    names, code = np.unique(labels[keep], return_inverse=True)
    if len(keep) < 3 or len(names) < 2:
        return float("nan")
    d = np.sqrt(sq_dists(x[keep], x[keep]))
    n = np.bincount(code)
    sums = d @ np.eye(len(names))[code]
    own = sums[np.arange(len(keep)), code] / np.maximum(n[code] - 1, 1)
    mean = sums / n
    mean[np.arange(len(keep)), code] = np.inf
    other = mean.min(axis=1)
    s = np.where(n[code] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
    return float(s.mean())


def ari(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted Rand index."""
    a, b = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda v: (v * (v - 1) / 2).sum()
    s, sa, sb, n = pairs(table), pairs(table.sum(axis=1)), pairs(table.sum(axis=0)), len(a)
    expected, most = sa * sb / max(n * (n - 1) / 2, 1), (sa + sb) / 2
    return 1.0 if most == expected else float((s - expected) / (most - expected))


def knn_affinity(x: np.ndarray, k: int) -> np.ndarray:
    """Symmetric 0/1 (0.5 one-sided) neighbour graph as a dense matrix."""
    _, index = neighbours(x, k)
    w = np.zeros((len(x), len(x)))
    w[np.repeat(np.arange(len(x)), index.shape[1]), index.ravel()] = 1.0
    return 0.5 * (w + w.T)


class Links:
    """A symmetric graph by rows: node i's neighbours are `to[ptr[i]:ptr[i + 1]]` with weights `w`."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        key, back = np.unique(a.astype(np.int64) * n + b, return_inverse=True)
        self.n, self.to = n, key % n
        self.w = np.bincount(back, weights=w, minlength=len(key)).astype(float)
        self.rows = key // n
        self.ptr = np.searchsorted(self.rows, np.arange(n + 1))

    def degree(self) -> np.ndarray:
        """Sum of each node's weights."""
        return np.bincount(self.rows, weights=self.w, minlength=self.n)

    def times(self, q: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """diag(left) W diag(right) q."""
        if not len(self.to):
            return np.zeros_like(q)
        part = np.add.reduceat(np.vstack([(self.w * right[self.to])[:, None] * q[self.to], np.zeros((1, q.shape[1]))]), self.ptr[:-1], axis=0)
        part[self.ptr[:-1] == self.ptr[1:]] = 0.0
        return part * left[:, None]

    def dense(self) -> np.ndarray:
        """The matrix of the weights."""
        out = np.zeros((self.n, self.n))
        out[self.rows, self.to] = self.w
        return out

    def among(self, nodes: np.ndarray) -> Links:
        """The graph of some of the nodes, numbered anew."""
        place = np.full(self.n, -1)
        place[nodes] = np.arange(len(nodes))
        held = (place[self.rows] >= 0) & (place[self.to] >= 0)
        return Links(len(nodes), place[self.rows[held]], place[self.to[held]], self.w[held])


def knn_links(x: np.ndarray, k: int) -> Links:
    """The graph of `knn_affinity` by rows."""
    _, index = neighbours(x, k)
    a, b = np.repeat(np.arange(len(x)), index.shape[1]), index.ravel()
    return Links(len(x), np.concatenate([a, b]), np.concatenate([b, a]), np.full(2 * len(a), 0.5))


#: Nodes up to which a graph's Laplacian is decomposed whole.
WHOLE = 500


def laplacian_vectors(w: np.ndarray | Links, m: int, tol: float = 1e-6, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Lowest `m` eigenvalues and vectors of the normalised Laplacian of a graph.

    Of a larger graph given by rows they are found by a block Krylov method that is
    started again from its best vectors until all `m` are eigenvectors within `tol`.
    """
    if isinstance(w, Links) and (w.n <= WHOLE or m > w.n // 10):
        w = w.dense()
    if not isinstance(w, Links):
        deg = np.maximum(w.sum(axis=1), 1e-12)
        s = 1.0 / np.sqrt(deg)
        value, vector = np.linalg.eigh(np.eye(len(w)) - w * s[:, None] * s[None, :])
        return value[:m], vector[:, :m]
    deg = np.maximum(w.degree(), 1e-12)
    s = 1.0 / np.sqrt(deg)
    half = lambda q: 0.5 * (q + w.times(q, s, s))  # noqa: E731  largest where the Laplacian is lowest
    wide = m + max(4, m // 2)
    q = np.random.default_rng(0).standard_normal((w.n, wide))
    q[:, 0] = np.sqrt(deg)
    q = np.linalg.qr(q)[0]
    for _ in range(rounds):
        basis, image = q, half(q)
        block = image
        for _ in range(7):
            for _ in range(2):
                block = block - basis @ (basis.T @ block)
            block = np.linalg.qr(block)[0]
            basis = np.hstack([basis, block])
            block = half(block)
            image = np.hstack([image, block])
        inner = basis.T @ image
        value, y = np.linalg.eigh((inner + inner.T) / 2)
        y = y[:, ::-1][:, :wide]
        q, moved, value = basis @ y, image @ y, value[::-1][:wide]
        if np.linalg.norm(moved[:, :m] - q[:, :m] * value[:m], axis=0).max() < tol:
            break
        q = np.linalg.qr(q)[0]
    return np.maximum(2.0 - 2.0 * value[:m], 0.0), q[:, :m]


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def landmarks(x: np.ndarray, most: int | None, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray | None]:
    """At most `most` rows (all of them without it), and for each row the five landmarks nearest to it if any were left out."""
    if most is None or len(x) <= most:
        return np.arange(len(x)), None
    chosen = np.sort(rng.choice(len(x), most, replace=False))
    return chosen, neighbours(x, 5, x[chosen])[1]


def embed(x: np.ndarray, m: int, k_nn: int, rng: np.random.Generator, most: int | None = None, drop_trivial: bool = True) -> np.ndarray:
    """Laplacian embedding; rows beyond the landmarks get the mean of the nearest landmarks' vectors."""
    chosen, near = landmarks(x, most, rng)
    value, v = laplacian_vectors(knn_links(x[chosen], k_nn), m + drop_trivial)
    if drop_trivial:
        v = v[:, 1:]
    return v if near is None else v[near].mean(axis=1)


def assignment(gain: np.ndarray) -> np.ndarray:
    """Column of each row such that the sum is greatest (shortest augmenting paths)."""
    n, m = gain.shape
    if n > m:
        back = assignment(gain.T)
        out = np.full(n, -1)
        out[back[back >= 0]] = np.flatnonzero(back >= 0)
        return out
    cost = -gain
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0] = i
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        j = 0
        while True:
            used[j] = True
            row = match[j]
            cur = cost[row - 1] - u[row] - v[1:]
            free = ~used[1:]
            better = free & (cur < low[1:])
            low[1:][better] = cur[better]
            way[1:][better] = j
            step = np.where(free, low[1:], np.inf)
            nxt = int(step.argmin()) + 1
            delta = low[nxt]
            u[match[used]] += delta
            v[used] -= delta
            low[1:][free] -= delta
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def align(reference: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """`labels` renamed to agree with `reference` as often as possible; noise stays noise, further clusters get new names."""
    out = np.full(len(labels), -1)
    names, code = np.unique(labels[labels >= 0], return_inverse=True)
    refs = np.unique(reference[reference >= 0])
    if not len(names) or not len(refs):
        return labels.copy()
    table = np.array([[((labels == a) & (reference == b)).sum() for b in refs] for a in names], dtype=float)
    to = assignment(table)
    fresh = int(max(refs.max(), 0)) + 1
    new = []
    for t in to:
        if t >= 0:
            new.append(int(refs[t]))
        else:
            new.append(fresh)
            fresh += 1
    out[labels >= 0] = np.array(new)[code]
    return out


def reassign_noise(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Noise gets the label of the nearest other point; all zero if there is none."""
    noise = labels < 0
    if not noise.any():
        return labels
    if noise.all():
        return np.zeros(len(labels), dtype=int)
    out = labels.copy()
    out[noise] = labels[~noise][neighbours(x[noise], 1, x[~noise])[1][:, 0]]
    return out


def principal(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores on the first `m` principal axes, and the share of variance of each."""
    c = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    var = s**2 / max((s**2).sum(), 1e-300)
    return u[:, :m] * s[:m], var[:m]


def zscore(x: np.ndarray) -> np.ndarray:
    """Columns in population deviations."""
    s = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(s > 0, s, 1.0)
