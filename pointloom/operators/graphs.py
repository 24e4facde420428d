"""Measures of the nodes of a graph given as undirected edges (`i`, `j`)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pointloom.operators.staging import discard, stage


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge once, smaller node first, no loops."""
    return edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).where("i <> j").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(`u`, `v`): every edge in both directions."""
    return edges.select(F.col("i").alias("u"), F.col("j").alias("v")).unionByName(edges.select(F.col("j").alias("u"), F.col("i").alias("v")))


def degrees(edges: DataFrame) -> DataFrame:
    """(`node`, `degree`, `share`): neighbours, and over the other nodes there are."""
    deg = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    n = deg.agg(F.count(F.lit(1)).alias("__pl_n"))  # a single row
    return deg.join(F.broadcast(n)).select("node", "degree", (F.col("degree") / (F.col("__pl_n") - 1)).alias("share"))


def clustering_coefficients(edges: DataFrame) -> DataFrame:
    """(`node`, `coefficient`): share of a node's pairs of neighbours that are neighbours; 0 below two neighbours.

    Edges are turned from the node of lower degree to the other, so that a hub pairs
    up few of its neighbours: the pairs number at most edges times the root of that.
    """
    deg = degrees(edges).select("node", "degree")
    d = edges.join(deg.select(F.col("node").alias("i"), F.col("degree").alias("di")), "i").join(deg.select(F.col("node").alias("j"), F.col("degree").alias("dj")), "j")
    low = F.struct("di", "i") < F.struct("dj", "j")
    turned = d.select(F.when(low, F.col("i")).otherwise(F.col("j")).alias("u"), F.when(low, F.col("j")).otherwise(F.col("i")).alias("v"))
    wedge = turned.alias("a").join(turned.alias("b"), (F.col("a.u") == F.col("b.u")) & (F.col("a.v") < F.col("b.v")))
    tri = wedge.select(F.col("a.u").alias("u"), F.col("a.v").alias("i"), F.col("b.v").alias("j")).join(edges, ["i", "j"])
    corners = tri.select(F.explode(F.array("u", "i", "j")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return deg.join(corners, "node", "left").select("node", F.when(F.col("degree") < 2, 0.0).otherwise(F.coalesce("t", F.lit(0)) / pairs).alias("coefficient"))


#: Rounds of an iteration between two staged tables.
ROUNDS_A_JOB = 5


def _until_still(start: DataFrame, step, rounds: int, tol: float, unit: bool) -> DataFrame:
    """Apply `step` to (`node`, `x`) `rounds` times at most, until some rounds together change `x` by less than `tol` in sum.

    The rounds between two staged tables are one job. With `unit`, `x` is brought to
    unit length at its end.
    """
    held = start
    done = 0
    while done < rounds:
        now = held
        for _ in range(min(ROUNDS_A_JOB, rounds - done)):
            now, done = step(now), done + 1
        size = Observation()
        raw = stage(now.observe(size, F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size")), "round")
        after = raw.select("node", F.col("x") / F.lit(size.get["size"] or 1.0)) if unit else raw
        after = after.toDF("node", "x")
        before = held.select("node", F.col("x").alias("old"))
        change = after.join(before, "node").agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0] or 0.0
        discard(held)
        after._pl_path = raw._pl_path
        held = after
        if change < tol:
            break
    return held


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tol: float = 1e-9) -> DataFrame:
    """(`node`, `rank`): a fixed number of rounds at most, fewer once the change in sum is below `tol`."""
    both = both_ways(edges)
    deg = stage(both.groupBy("u").agg(F.count(F.lit(1)).alias("deg")), "degrees")
    links = stage(both.join(deg, "u"), "links")
    n = max(1, deg.count())

    def step(rank: DataFrame) -> DataFrame:
        part = links.join(rank.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("x") / F.col("deg")).alias("x"))
        return part.select("node", (F.lit((1 - damping) / n) + damping * F.col("x")).alias("x"))

    start = stage(deg.select(F.col("u").alias("node"), F.lit(1.0 / n).alias("x")), "rank")
    return _until_still(start, step, rounds, tol, False).select("node", F.col("x").alias("rank"))


def eigenvector_centrality(edges: DataFrame, rounds: int = 200, tol: float = 1e-9) -> DataFrame:
    """(`node`, `centrality`): power iteration of the adjacency from equal weights, to unit length."""
    links = stage(both_ways(edges), "links")
    nodes = links.select(F.col("u").alias("node")).distinct()
    n = nodes.count()

    def step(v: DataFrame) -> DataFrame:
        return links.join(v.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("x").alias("x"))

    start = stage(nodes.select("node", F.lit(1.0 / max(1, n) ** 0.5).alias("x")), "vector")
    return _until_still(start, step, rounds, tol, True).select("node", F.abs("x").alias("centrality"))


def hop_distances(edges: DataFrame, max_hops: int = 1000) -> DataFrame:
    """(`source`, `node`, `hops`) for all reachable pairs: a frontier per round, until none is new.

    A neighbour of a node at some distance is as far, one nearer or one farther; so what
    a round reaches is compared with the last two frontiers, not with all that was seen.
    """
    links = stage(both_ways(edges), "links")
    front = stage(links.select(F.col("u").alias("source"), F.col("u").alias("node")).distinct().withColumn("hops", F.lit(0)), "front")
    last, seen = None, front
    for hop in range(1, max_hops):
        step = front.join(links, front["node"] == links["u"]).select("source", F.col("v").alias("node")).distinct()
        near = front if last is None else front.unionByName(last)
        new = stage(step.join(near, ["source", "node"], "left_anti").withColumn("hops", F.lit(hop)), "front")
        if new.isEmpty():
            break
        last, front, seen = front, new, seen.unionByName(new)
    return seen


def average_path(edges: DataFrame) -> DataFrame:
    """(`node`, `avg_path`): mean hops to the nodes that can be reached."""
    return hop_distances(edges).where("hops > 0").groupBy(F.col("source").alias("node")).agg(F.avg("hops").alias("avg_path"))


def betweenness(edges: DataFrame) -> DataFrame:
    """(`node`, `betweenness`): shares of shortest paths through a node over (n - 1)(n - 2), both directions counted.

    Level by level for all sources at once: path counts on the way out, dependencies
    on the way back.
    """
    hops = stage(hop_distances(edges), "hops")
    links = stage(both_ways(edges), "links")
    deepest = hops.agg(F.max("hops")).first()[0] or 0
    n = hops.select("node").distinct().count()
    a = hops.select("source", F.col("node").alias("u"), F.col("hops").alias("hu"))
    b = hops.select("source", F.col("node").alias("v"), F.col("hops").alias("hv"))
    dag = stage(a.join(links, "u").join(b, ["source", "v"]).where("hv = hu + 1").select("source", "u", "v", "hv"), "dag")
    sigma = hops.where("hops = 0").select("source", "node", F.lit(1.0).alias("sigma"), "hops")
    for h in range(1, deepest + 1):
        before = sigma.where(F.col("hops") == h - 1).select("source", F.col("node").alias("u"), "sigma")
        level = dag.where(F.col("hv") == h).join(before, ["source", "u"]).groupBy("source", F.col("v").alias("node")).agg(F.sum("sigma").alias("sigma")).withColumn("hops", F.lit(h))
        sigma = sigma.unionByName(stage(level, "sigma"))
    sigma = stage(sigma, "sigma")
    delta = sigma.where(F.col("hops") == deepest).select("source", "node", F.lit(0.0).alias("delta"), "sigma")
    levels = [delta]
    for h in range(deepest, 0, -1):
        own = sigma.where(F.col("hops") == h - 1).select("source", F.col("node").alias("u"), F.col("sigma").alias("su"))
        below = levels[-1].select("source", F.col("node").alias("v"), "delta", F.col("sigma").alias("sv"))
        part = dag.where(F.col("hv") == h).join(below, ["source", "v"]).join(own, ["source", "u"]).groupBy("source", "u").agg(F.sum(F.col("su") / F.col("sv") * (1 + F.col("delta"))).alias("delta"))
        level = own.join(part, ["source", "u"], "left").select("source", F.col("u").alias("node"), F.coalesce("delta", F.lit(0.0)).alias("delta"), F.col("su").alias("sigma"))
        levels.append(stage(level, "delta"))
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    scale = float(max(1, (n - 1) * (n - 2)))
    return whole.where("source <> node").groupBy("node").agg((F.sum("delta") / scale).alias("betweenness"))


#: Nodes of a graph that one task takes in as a matrix.
MAX_NODES = 3000


def _paths(w: np.ndarray, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the shares of shortest paths through each node, and mean hops from each, by levels from a batch of sources at a time."""
    n = len(w)
    between, path = np.zeros(n), np.zeros(n)
    for at in range(0, n, batch):
        source = np.arange(at, min(at + batch, n))
        hops = np.full((len(source), n), -1, dtype=np.int32)
        sigma = np.zeros((len(source), n))
        hops[np.arange(len(source)), source], sigma[np.arange(len(source)), source] = 0, 1.0
        level = 0
        while True:
            reach = np.where(hops == level, sigma, 0.0) @ w
            new = (reach > 0) & (hops < 0)
            if not new.any():
                break
            level += 1
            hops[new], sigma[new] = level, reach[new]
        delta = np.zeros_like(sigma)
        for h in range(level, 0, -1):
            below = np.where(hops == h, (1 + delta) / np.where(sigma > 0, sigma, 1.0), 0.0)
            delta += np.where(hops == h - 1, sigma * (below @ w), 0.0)
        delta[np.arange(len(source)), source] = 0.0
        between += delta.sum(axis=0)
        far = hops > 0
        path[source] = np.where(far.any(axis=1), np.where(far, hops, 0).sum(axis=1) / np.maximum(far.sum(axis=1), 1), 0.0)
    return between, path


def small_features(w: np.ndarray, m: int) -> np.ndarray:
    """Six measures and `m` Laplacian coordinates of the nodes of a graph given as a 0/1 matrix."""
    n = len(w)
    deg = w.sum(axis=1)
    pairs = deg * (deg - 1) / 2
    tri = np.einsum("ij,ij->i", w @ w, w) / 2
    coefficient = np.where(deg < 2, 0.0, tri / np.where(pairs > 0, pairs, 1.0))
    v = np.full(n, 1 / np.sqrt(n))
    rank = np.full(n, 1 / n)
    for _ in range(200):
        new = w @ v
        new /= max(np.linalg.norm(new), 1e-300)
        done = np.abs(new - v).sum() < 1e-9
        v = new
        if done:
            break
    for _ in range(100):
        new = 0.15 / n + 0.85 * (w @ (rank / np.where(deg > 0, deg, 1)))
        done = np.abs(new - rank).sum() < 1e-9
        rank = new
        if done:
            break
    between, path = _paths(w)
    r = 1.0 / np.sqrt(np.maximum(deg, 1e-12))
    value, vector = np.linalg.eigh(np.eye(n) - w * r[:, None] * r[None, :])
    value, vector = value[1 : m + 1], vector[:, 1 : m + 1]
    spectral = np.zeros((n, m))
    spectral[:, : vector.shape[1]] = vector / np.sqrt(np.maximum(value, 1e-6))
    return np.column_stack([deg / max(n - 1, 1), coefficient, np.abs(v), between / max((n - 1) * (n - 2), 1), rank, path, spectral])


def node_features(edges: DataFrame, m: int = 10) -> DataFrame:
    """(`node`, `x`): degree, clustering, eigenvector centrality, betweenness, PageRank, mean path and `m` Laplacian coordinates.

    The coordinates need the whole matrix in one task, so a graph of more than
    `MAX_NODES` nodes is refused; its other measures are the functions above, which
    run over tables of edges of any size.
    """

    def read(frames):
        held = [f for f in frames if len(f)]
        if not held:
            return
        e = pd.concat(held)
        names, code = np.unique(np.concatenate([e["i"], e["j"]]), return_inverse=True)
        if len(names) > MAX_NODES:
            raise ValueError(f"more than {MAX_NODES} nodes")
        w = np.zeros((len(names), len(names)))
        w[code[: len(e)], code[len(e) :]] = 1.0
        yield pd.DataFrame({"node": names, "x": list(small_features(np.maximum(w, w.T), m))})

    return undirected(edges).coalesce(1).mapInPandas(read, "node long, x array<double>")
