"""Clustering as a sequence of primitive moves: environment, traces, a cloned policy.

The environment works on a matrix of bounded size; traces and returns are tables.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from pointloom.operators.clustering import kernels as U
from pointloom.operators.clustering.base import REGISTRY, Fit, Step, register

ACTIONS = ("kpp_init", "assign_to_centers", "update_centers", "medoid_swap", "ward_merge", "density_partition", "eigen_embed", "outlier_trim")
N_FEATURES = 20
TRACE = "episode_id bigint, dataset string, algo string, step_idx bigint, action string, params string, state_features array<float>, reward double"


@dataclass(frozen=True)
class State:
    """An immutable point of an episode."""

    x: np.ndarray
    embedding: np.ndarray
    labels: np.ndarray
    k: int
    centers: np.ndarray | None = None
    step_idx: int = 0
    cost: float = 0.0
    cost_initial: float = 1.0
    embedded: bool = False

    @property
    def silhouette(self) -> float:
        """Silhouette in the embedding, 0 if undefined."""
        return float(np.nan_to_num(U.silhouette(self.embedding, self.labels, 300), nan=0.0))

    def features(self) -> np.ndarray:
        """Twenty numbers in the order that a policy is trained on; what is undefined is 0.

        Step, k, clusters, clusters over k, share of noise, silhouette, cost over the
        first, whether there are centres, dimensions of the embedding, relative spread
        of sizes, least over greatest size, mean distance within, mean and least
        distance between centroids, greatest range, whether there are as many, more or
        fewer clusters than k, points, dimensions.
        """
        inside = self.labels >= 0
        names, code, counts = np.unique(self.labels[inside], return_inverse=True, return_counts=True)
        found, k = len(names), max(1.0, float(self.k))
        within = between = nearest = 0.0
        if found >= 2 and len(self.labels) <= 2000:
            held = self.embedding[inside]
            c = np.array([held[code == i].mean(axis=0) for i in range(found)])
            far = np.linalg.norm(held - c[code], axis=1)
            several = counts >= 2
            within = float((np.bincount(code, weights=far) / counts)[several].mean()) if several.any() else 0.0
            pairs = np.sqrt(U.sq_dists(c, c))[np.triu_indices(found, 1)]
            between, nearest = float(pairs.mean()), float(pairs.min())
        f = [
            self.step_idx, self.k, found, found / k, 1.0 - inside.mean() if len(inside) else 0.0, self.silhouette, self.cost / (self.cost_initial if self.cost_initial > 0 else 1.0), self.centers is not None, self.embedding.shape[1],
            counts.std() / counts.mean() if found else 0.0, counts.min() / counts.max() if found else 0.0, within, between, nearest, np.ptp(self.embedding) if self.embedding.size else 0.0,
            found == self.k, found > self.k, found < self.k, len(self.labels), self.x.shape[1],
        ]
        return np.nan_to_num(np.array(f, dtype=np.float32), posinf=0.0, neginf=0.0)


def inertia(x: np.ndarray, labels: np.ndarray, centers: np.ndarray | None = None) -> float:
    """Squared distances to the own centre, noise aside; centres are the labels' means where not given."""
    total = 0.0
    for c in np.unique(labels[labels >= 0]):
        rows = x[labels == c]
        center = centers[c] if centers is not None and c < len(centers) else rows.mean(axis=0)
        total += float(((rows - center) ** 2).sum())
    return total


def kpp_init(s: State, rng, **_) -> State:
    """Best of five k-means++ starts."""
    best = min((s.embedding[U.kpp(s.embedding, s.k, rng)] for _ in range(5)), key=lambda c: U.sq_dists(s.embedding, c).min(axis=1).sum())
    return replace(s, centers=best, labels=U.sq_dists(s.embedding, best).argmin(axis=1))


def assign_to_centers(s: State, rng, **_) -> State:
    """Nearest centre; nothing without centres."""
    return s if s.centers is None else replace(s, labels=U.sq_dists(s.embedding, s.centers).argmin(axis=1))


def update_centers(s: State, rng, **_) -> State:
    """Mean of each label; a label without points keeps its centre."""
    keep = s.labels >= 0
    before = s.centers if s.centers is not None else np.zeros((max(s.k, int(s.labels.max(initial=0)) + 1), s.embedding.shape[1]))
    if keep.any() and s.labels.max() >= len(before):
        before = np.vstack([before, np.zeros((s.labels.max() + 1 - len(before), before.shape[1]))])
    return replace(s, centers=U.means(s.embedding[keep], s.labels[keep], before))


def medoid_swap(s: State, rng, out: int = 0, into: int | None = None, **_) -> State:
    """A centre becomes a point; nothing if either is out of bounds."""
    into = int(rng.integers(len(s.x))) if into is None else into
    if s.centers is None or not 0 <= out < len(s.centers) or not 0 <= into < len(s.x):
        return s
    c = s.centers.copy()
    c[out] = s.embedding[into]
    return replace(s, centers=c)


def ward_merge(s: State, rng, **_) -> State:
    """The two clusters with the nearest means become the one with the lower label."""
    names = np.unique(s.labels[s.labels >= 0])
    if len(names) < 2:
        return s
    c = np.array([s.embedding[s.labels == v].mean(axis=0) for v in names])
    d = U.sq_dists(c, c) + np.diag(np.full(len(c), np.inf))
    i, j = sorted(divmod(int(d.argmin()), len(c)))
    return replace(s, labels=np.where(s.labels == names[j], names[i], s.labels), centers=None)


def density_partition(s: State, rng, eps: float = 0.0, min_samples: int = 5, **_) -> State:
    """Density clusters; without a radius that at the 80th percentile of neighbour distances."""
    if not eps or eps <= 0:
        eps = float(np.percentile(U.neighbours(s.embedding, min_samples)[0][:, -1], 80)) or 1e-9
    return replace(s, labels=U.density_clusters(s.embedding, eps, min_samples), centers=None)


def eigen_embed(s: State, rng, **_) -> State:
    """Spectral embedding with rows of length one, once."""
    if s.embedded or len(s.x) < 5:
        return s
    return replace(s, embedding=U.unit_rows(U.embed(s.x, max(2, s.k), min(10, len(s.x) - 1), rng)), embedded=True, centers=None)


def outlier_trim(s: State, rng, q: float = 0.05, **_) -> State:
    """The share `q` (0 to 0.5, one point at least) of highest outlier factor becomes noise."""
    m = max(1, int(np.clip(q, 0, 0.5) * len(s.x)))
    labels = s.labels.copy()
    labels[np.argsort(-U.lof(s.embedding), kind="stable")[:m]] = -1
    return replace(s, labels=labels)


PRIMITIVES = {f.__name__: f for f in (kpp_init, assign_to_centers, update_centers, medoid_swap, ward_merge, density_partition, eigen_embed, outlier_trim)}


class Environment:
    """Episodes over one matrix: reward is the relative fall of the cost, clipped to -1..1; an error in a move costs 0.1."""

    def __init__(self, x: np.ndarray, k: int, seed: int = 0, max_steps: int = 20):
        self.x, self.k, self.rng, self.max_steps = np.asarray(x, dtype=float), k, np.random.default_rng(seed), max_steps
        self.reset()

    def reset(self) -> State:
        """Random labels."""
        labels = self.rng.integers(0, self.k, len(self.x))
        cost = inertia(self.x, labels)
        self.state = State(self.x, self.x, labels, self.k, None, 0, cost, max(cost, 1e-12))
        self.recent: list[float] = []
        return self.state

    def legal(self) -> list[tuple[str, dict[str, Any]]]:
        """Moves that make sense now, with a few values of their parameters."""
        s = self.state
        found: list[tuple[str, dict[str, Any]]] = [("kpp_init", {}), ("update_centers", {}), ("density_partition", {"eps": 0.0})]
        if s.centers is not None:
            found += [("assign_to_centers", {})] + [("medoid_swap", {"out": o}) for o in range(min(3, len(s.centers)))]
        if len(np.unique(s.labels[s.labels >= 0])) > max(1, s.k):
            found.append(("ward_merge", {}))
        if not s.embedded:
            found.append(("eigen_embed", {}))
        if (s.labels >= 0).mean() > 0.7:
            found += [("outlier_trim", {"q": q}) for q in (0.02, 0.05, 0.1)]
        return found

    def step(self, action: str, **params: Any) -> tuple[State, float, bool]:
        """Apply a move: the new state, its reward and whether the episode is over."""
        before = self.state
        try:
            after = PRIMITIVES[action](before, self.rng, **params)
            cost = inertia(after.embedding, after.labels, after.centers)
            scale = before.cost_initial if after.embedded == before.embedded else max(cost, 1e-12)
            reward = float(np.clip(-(cost - before.cost) / scale, -1, 1)) if after.embedded == before.embedded else 0.0
        except (ValueError, np.linalg.LinAlgError, IndexError):
            after, cost, scale, reward = before, before.cost, before.cost_initial, -0.1
        self.state = replace(after, cost=cost, cost_initial=scale, step_idx=before.step_idx + 1)
        self.recent = [*self.recent, abs(reward)][-3:]
        flat = len(self.recent) == 3 and sum(self.recent) < 1e-4
        return self.state, reward, self.state.step_idx >= self.max_steps or self.state.silhouette > 0.95 or flat


PLANS: dict[str, Sequence[tuple[str, dict[str, Any]]]] = {
    "kmeans": [("kpp_init", {}), *[("update_centers", {}), ("assign_to_centers", {})] * 5],
    "spectral": [("eigen_embed", {}), ("kpp_init", {}), *[("update_centers", {}), ("assign_to_centers", {})] * 4],
    "dbscan": [("density_partition", {"eps": 0.0}), ("ward_merge", {}), ("ward_merge", {})],
    "trimmed": [("outlier_trim", {"q": 0.05}), ("kpp_init", {}), *[("update_centers", {}), ("assign_to_centers", {})] * 3],
    "medoid": [("kpp_init", {}), *[("medoid_swap", {"out": 0}), ("assign_to_centers", {})] * 2, ("update_centers", {}), ("assign_to_centers", {})],
}


def episode(x: np.ndarray, k: int, plan: str, seed: int, episode_id: int, dataset: str) -> list[tuple]:
    """Rows of `TRACE` of a plan replayed in the environment."""
    env, rows = Environment(x, k, seed), []
    for i, (action, params) in enumerate(PLANS[plan]):
        features = env.state.features()
        _, reward, done = env.step(action, **params)
        rows.append((episode_id, dataset, plan, i, action, json.dumps(params), [float(v) for v in features], reward))
        if done:
            break
    return rows


def collect_traces(spark: SparkSession, tasks: DataFrame) -> DataFrame:
    """Traces of every plan on every task (`dataset`, `n_samples`, `n_features`, `k`, `seed`), a task's data being drawn where it is replayed.

    An episode per task and plan, spread over the cluster; no task gives an empty table of the same columns.
    """
    from pointloom.sources.generators import DataSpec, draw

    plans = spark.createDataFrame([(i, p) for i, p in enumerate(PLANS)], "plan_id int, plan string")
    spread = tasks.crossJoin(plans).repartition(max(1, spark.sparkContext.defaultParallelism), "dataset", "seed", "plan")  # five plans

    def replay(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                x, _ = draw(r.dataset, DataSpec(int(r.n_samples), int(r.n_features), int(r.k), 1.0, int(r.seed)))
                rows += episode(x, int(r.k), r.plan, int(r.seed), int(r.seed) * 100 + int(r.plan_id), r.dataset)
            yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in TRACE.split(", ")])

    return spread.mapInPandas(replay, TRACE)


class Policy:
    """A small network from state features to a move and the return to expect, cloned from traces."""

    def __init__(self, seed: int = 0, hidden: int = 32):
        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.standard_normal((N_FEATURES, hidden)) / np.sqrt(N_FEATURES), np.zeros(hidden)
        self.wa, self.ba = rng.standard_normal((hidden, len(ACTIONS))) / np.sqrt(hidden), np.zeros(len(ACTIONS))
        self.wv, self.bv = rng.standard_normal((hidden, 1)) / np.sqrt(hidden), np.zeros(1)
        self.mu, self.sd = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def forward(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hidden, probabilities of moves, value) of rows of features."""
        h = np.tanh((f - self.mu) / self.sd @ self.w1 + self.b1)
        z = h @ self.wa + self.ba
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return h, p / p.sum(axis=1, keepdims=True), (h @ self.wv + self.bv).ravel()

    def fit(self, f: np.ndarray, a: np.ndarray, g: np.ndarray, held: np.ndarray, epochs: int = 400, rate: float = 0.05, patience: int = 30) -> float:
        """Cross entropy with class weights count ** -0.25 plus squared error of the value; stops when held-out accuracy hasn't risen for `patience` rounds."""
        self.mu, self.sd = f.mean(axis=0), np.where(f.std(axis=0) > 0, f.std(axis=0), 1.0)
        weight = np.bincount(a, minlength=len(ACTIONS)).clip(1) ** -0.25
        train = ~held
        best, since, kept = -1.0, 0, None
        for _ in range(epochs):
            h, p, v = self.forward(f[train])
            w = weight[a[train]] / weight[a[train]].sum()
            dz = (p - np.eye(len(ACTIONS))[a[train]]) * w[:, None]
            dv = ((v - g[train]) / train.sum())[:, None]
            dh = (dz @ self.wa.T + dv @ self.wv.T) * (1 - h**2)
            for name, grad in (("wa", h.T @ dz), ("ba", dz.sum(axis=0)), ("wv", h.T @ dv), ("bv", dv.sum(axis=0)), ("w1", ((f[train] - self.mu) / self.sd).T @ dh), ("b1", dh.sum(axis=0))):
                setattr(self, name, getattr(self, name) - rate * 10 * grad)
            check = held if held.any() else train
            acc = float((self.forward(f[check])[1].argmax(axis=1) == a[check]).mean())
            if acc > best:
                best, since, kept = acc, 0, [getattr(self, n).copy() for n in ("w1", "b1", "wa", "ba", "wv", "bv")]
            else:
                since += 1
                if since > patience:
                    break
        for n, v in zip(("w1", "b1", "wa", "ba", "wv", "bv"), kept, strict=True):
            setattr(self, n, v)
        return best


def train_policy(rows: Sequence[tuple], gamma: float = 0.95, seed: int = 0) -> tuple[Policy, float]:
    """A policy from rows of `TRACE`, a fifth of the episodes held out, and its held-out accuracy."""
    f = np.array([r[6] for r in rows], dtype=float)
    a = np.array([ACTIONS.index(r[4]) for r in rows])
    ep = np.array([r[0] for r in rows])
    g = np.zeros(len(rows))
    for e in np.unique(ep):
        at, total = np.flatnonzero(ep == e), 0.0
        for i in at[::-1]:
            total = rows[i][7] + gamma * total
            g[i] = total
    ids = np.unique(ep)
    held = np.isin(ep, np.random.default_rng(seed).permutation(ids)[: max(1, len(ids) // 5)])
    policy = Policy(seed)
    return policy, policy.fit(f, a, g, held)


def rollout(policy: Policy, x: np.ndarray, k: int, seed: int, max_steps: int = 12) -> tuple[State, list[Step]]:
    """An episode of the policy: the likeliest legal move each time, its parameters by reward plus value of what follows."""
    env, steps = Environment(x, k, seed, max_steps), []
    done = False
    while not done:
        p = policy.forward(env.state.features()[None, :])[1][0]
        legal = env.legal()
        name = max({a for a, _ in legal}, key=lambda a: (p[ACTIONS.index(a)], a))
        best = None
        for _, params in [v for v in legal if v[0] == name][:6]:
            trial = Environment.__new__(Environment)
            trial.__dict__ = env.__dict__ | {"rng": np.random.default_rng(seed + env.state.step_idx), "recent": list(env.recent)}
            state, reward, _ = trial.step(name, **params)
            value = reward + float(policy.forward(state.features()[None, :])[2][0])
            if best is None or value > best[0]:
                best = (value, params)
        state, reward, done = env.step(name, **best[1])
        steps.append(Step(state.cost, {"type": name, **best[1]}, {"silhouette": state.silhouette}, reward >= 0))
    return env.state, steps


_default: dict[str, Policy] = {}


def default_policy() -> Policy:
    """A policy cloned from plans replayed on small generated data; trained once per process."""
    if "policy" not in _default:
        from pointloom.sources.generators import DataSpec, draw

        rows = []
        for i, (name, k) in enumerate((("blobs", 3), ("moons", 2), ("circles", 2), ("mdcgen", 3))):
            x, _ = draw(name, DataSpec(120, 3, k, 0.6, i))
            for j, plan in enumerate(PLANS):
                rows += episode(x, k, plan, i, i * 10 + j, name)
        _default["policy"] = train_policy(rows)[0]
    return _default["policy"]


@register("rl_pipeline")
def rl_pipeline(x, k, rng, policy: Policy | None = None, rollouts: int = 3, most: int | None = None, **_) -> Fit:
    """Best of several rollouts: those with the right number of clusters first, then a raw silhouette of 0.40, then one in the embedding; noise goes to a cluster of its own."""
    k = max(2, min(k or 3, len(x) - 1))
    policy = policy or default_policy()
    chosen = np.arange(len(x)) if most is None or len(x) <= most else np.sort(rng.choice(len(x), most, replace=False))
    found = []
    for i in range(rollouts):
        state, steps = rollout(policy, x[chosen], k, int(rng.integers(1 << 30)) + i)
        n = len(np.unique(state.labels[state.labels >= 0]))
        raw = float(np.nan_to_num(U.silhouette(x[chosen], state.labels, 300), nan=-1.0))
        tier = 0 if n == k else 1 if not state.embedded and raw >= 0.40 else 2 if state.embedded and state.silhouette >= 0.40 else 3
        found.append((tier, -max(raw, state.silhouette if state.embedded else -1.0), i, state.labels, steps))
    tier, _, _, labels, steps = min(found, key=lambda v: v[:3])
    labels = np.where(labels < 0, labels.max() + 1, labels)
    if len(chosen) < len(x):
        full = labels[U.neighbours(x, 1, x[chosen])[1][:, 0]]
        full[chosen] = labels
        labels = full
    return Fit(labels, {"tier": tier}, steps)


assert set(ACTIONS) == set(PRIMITIVES) and "kmeans" in REGISTRY
