"""Neighbours, measures and graphs against brute force and closed forms."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pointloom.operators import graphs as G
from pointloom.operators import kmeans as K
from pointloom.operators import metrics as M
from pointloom.operators import neighbors as N
from pointloom.operators.clustering import kernels as U


def _points(spark, x, labels=None):
    rows = [(i, [float(v) for v in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "point_id long, x array<double>, label int")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.4, (40, 3)) for c in (0, 3, 6)])
    return np.vstack([x, x[:5], rng.uniform(-3, 9, (6, 3))])


@pytest.mark.parametrize("block", [17, 5000])
def test_knn_with_ties(spark, cloud, block):
    d = np.round(np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(-1)), 9)
    got = {(r["i"], r["rk"]): (r["j"], r["d"]) for r in N.knn(_points(spark, cloud), 4, block=block).collect()}
    for i in range(len(cloud)):
        order = sorted((d[i, j], j) for j in range(len(cloud)) if j != i)[:4]
        assert [got[i, r + 1] for r in range(4)] == [(j, v) for v, j in order]


@pytest.mark.parametrize("block", [17, 5000])
def test_dbscan_equals_the_kernel(spark, cloud, block):
    got = {r["point_id"]: r["label"] for r in N.dbscan(_points(spark, cloud), 0.6, 5, block).collect()}
    want = U.density_clusters(cloud, 0.6, 5)
    label = np.array([got[i] for i in range(len(cloud))])
    assert ((label == -1) == (want == -1)).all()
    core = want >= 0
    assert U.ari(label[core], want[core]) > 0.999


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, small, monkeypatch):
    monkeypatch.setattr(N, "SMALL_GRAPH", small)
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 260)]
    nodes = spark.createDataFrame([(i,) for i in range(300)], "node long")
    got = {r["node"]: r["component"] for r in N.components(spark.createDataFrame(pairs, "i long, j long"), nodes).collect()}
    home = U.connected(300, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    least = {h: min(np.flatnonzero(home == h)) for h in set(home)}
    assert got == {i: least[home[i]] for i in range(300)}


def test_one_nn_and_lof(spark, cloud):
    lof = {r["i"]: r["lof"] for r in N.local_outlier_factor(N.knn(_points(spark, cloud), 8)).collect()}
    assert np.allclose([lof[i] for i in range(len(cloud))], U.lof(cloud, 8), rtol=1e-6)
    labelled = _points(spark, [[0, 0], [5, 5]], [3, 4])
    asked = _points(spark, [[1, 1], [4, 4], [9, 9]])
    assert {r["point_id"]: r["label"] for r in N.one_nn(asked, labelled.selectExpr("point_id + 100 as point_id", "x", "label")).collect()} == {0: 3, 1: 4, 2: 4}


SQUARES = [(0, 0), (0, 1), (1, 0), (1, 1), (10, 0), (10, 1), (11, 0), (11, 1)]


def test_two_squares(spark):
    df = _points(spark, SQUARES, [0] * 4 + [1] * 4)
    m = M.internal(df, 2).first()
    assert (m["compactness"], m["separation"], m["n_clusters_found"]) == (0.5, 100.0, 2)
    assert math.isclose(m["davies_bouldin"], 2 * math.sqrt(0.5) / 10)
    assert math.isclose(M.dunn(df).first()["dunn"], 9 / math.sqrt(2))
    s = np.mean([r["silhouette"] for r in M.silhouette_samples(df, 3).collect()])
    assert math.isclose(s, U.silhouette(np.array(SQUARES, float), np.array([0] * 4 + [1] * 4)))


def test_measures_of_degenerate_labelings(spark):
    one = _points(spark, SQUARES, [0] * 8)
    assert M.internal(one, 2).first()["davies_bouldin"] is None
    assert M.dunn(one).first()["dunn"] is None
    assert M.calinski_harabasz(one, 2).first()["calinski_harabasz"] is None
    assert {r["silhouette"] for r in M.silhouette_samples(one).collect()} == {None}
    noise = _points(spark, SQUARES, [-1] * 8)
    assert M.internal(noise, 2).first()["compactness"] is None


@pytest.mark.parametrize(("a", "b", "ari", "nmi"), [([0, 0, 1, 1], [5, 5, 7, 7], 1.0, 1.0), ([0, 0, 1, 1], [0, 1, 0, 1], -0.5, 0.0)])
def test_ari_and_nmi(spark, a, b, ari, nmi):
    r = M.external(spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int"), "a", "b").first()
    assert math.isclose(r["ari"], ari, abs_tol=1e-12) and math.isclose(r["nmi"], nmi, abs_tol=1e-12)


def _edges(spark, pairs):
    return G.undirected(spark.createDataFrame(pairs, "i long, j long"))


def test_triangle_with_a_pendant(spark):
    e = _edges(spark, [(0, 1), (0, 2), (1, 2), (2, 3), (2, 1), (3, 3)])
    assert {r["node"]: r["degree"] for r in G.degrees(e).collect()} == {0: 2, 1: 2, 2: 3, 3: 1}
    got = {r["node"]: r["coefficient"] for r in G.clustering_coefficients(e).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 1 / 3, 3: 0.0}
    assert math.isclose(sum(r["rank"] for r in G.pagerank(e).collect()), 1.0, abs_tol=1e-6)


def test_modularity_of_two_triangles(spark):
    e = _edges(spark, [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)])
    labels = spark.createDataFrame([(i, i // 3) for i in range(6)], "point_id long, label int")
    from pyspark.sql import functions as F

    assert math.isclose(M.modularity(e.withColumn("weight", F.lit(1.0)), labels).first()["modularity"], 5 / 14)


def test_paths_of_a_line(spark):
    e = _edges(spark, [(0, 1), (1, 2), (2, 3)])
    got = {r["node"]: r["avg_path"] for r in G.average_path(e).collect()}
    assert got == {0: 2.0, 1: 4 / 3, 2: 4 / 3, 3: 2.0}
    between = {r["node"]: r["betweenness"] for r in G.betweenness(e).collect()}
    assert between == {0: 0.0, 1: 4 / 6, 2: 4 / 6, 3: 0.0}


@pytest.mark.parametrize("trim", [0.0, 0.1, 0.5])
def test_lloyd_equals_the_kernel(spark, cloud, trim):
    df = _points(spark, cloud)
    start = cloud[[0, 50, 100]]
    fit = K.lloyd(df, start, max_iter=4, tol=0.0, trim=trim)
    c = start.copy()
    for _ in range(4):
        label, sq = K.nearest_center(cloud, c)
        new = c.copy()
        for j in range(3):
            mine = sorted(np.flatnonzero(label == j), key=lambda i: (sq[i], i))
            keep = mine[: max(1, math.floor(len(mine) * (1 - trim)))] if trim else mine
            new[j] = cloud[keep].mean(axis=0)
        c = new
    assert np.allclose(fit.centers, c)


def test_node_features_of_the_karate_club(spark):
    from pointloom.sources.generators import FIRST_FACTION, KARATE, karate_edges

    assert sum(map(len, KARATE.values())) == 78 and len(FIRST_FACTION) == 17
    rows = {r["node"]: r["x"] for r in G.node_features(karate_edges(spark)).collect()}
    assert len(rows) == 34 and all(len(x) == 16 for x in rows.values())
    assert max(rows, key=lambda n: rows[n][0]) == 33
    assert math.isclose(rows[0][3], 0.43763528138528146)  # the published betweenness of member 1
    side = {n: x[6] > 0 for n, x in rows.items()}
    agree = sum(side[n] == (n in FIRST_FACTION) for n in rows)
    assert max(agree, 34 - agree) >= 30


def test_node_features_equal_the_measures_over_tables(spark):
    e = _edges(spark, [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 5), (3, 5), (5, 6)])
    x = {r["node"]: r["x"] for r in G.node_features(e).collect()}
    tables = [
        G.degrees(e).select("node", "share"), G.clustering_coefficients(e), G.eigenvector_centrality(e, 12, 0.0), G.betweenness(e), G.pagerank(e, rounds=30), G.average_path(e),
    ]
    for i, t in enumerate(tables):
        for node, v in t.collect():
            assert math.isclose(x[node][i], v, abs_tol=0.05 if i == 2 else 1e-3 if i == 4 else 1e-9), (i, node)


def test_graph_queries_take_the_whole_graph(spark, monkeypatch):
    from pointloom.plans import cluster_queries as C
    from pointloom.plans import point_queries as P

    fan = G.undirected(spark.range(1, 81).selectExpr("0L i", "id j").unionByName(spark.range(40).selectExpr("2 * id + 1 i", "2 * id + 2 j")))
    monkeypatch.setattr(C, "_edges", lambda *_: fan)
    monkeypatch.setattr(P, "_edges", lambda *_: fan)
    between = {r["node"]: r["betweenness"] for r in C.graph_betweenness(spark, "").collect()}
    assert len(between) == 81 and math.isclose(between[0], 78 / 79, abs_tol=1e-6) and between[80] == 0.0
    link = np.zeros((81, 81))
    for r in fan.collect():
        link[r["i"], r["j"]] = link[r["j"], r["i"]] = 1.0
    rank = np.linalg.solve(np.eye(81) - 0.85 * link / link.sum(axis=0), np.full(81, 0.15 / 81))
    got = {r["node"]: r["rank"] for r in P.pagerank(spark, "").collect()}
    assert all(abs(got[i] - rank[i]) < 1e-6 for i in range(81))


def test_series_do_not_hang_on_the_ranges(spark):
    """Features of series cut into ranges of seven rows equal those of each series as an array, by NumPy."""
    from pointloom.operators import series as T
    from pointloom.sources.generators import _series_features

    rng = np.random.default_rng(3)
    held = {"a": rng.normal(size=60), "b": np.full(12, 2.0), None: rng.normal(size=9).cumsum(), "one": np.array([5.0])}
    rows = [(k, i, float(v)) for k, x in held.items() for i, v in enumerate(x)] + [("a", 999, None), ("a", 998, float("nan")), ("gone", 1, None)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "k string, t int, v double").repartition(5)
    s = T.positioned(df, "k", ["t"], "v", rows=7)
    assert {k: [r["v"] for r in sorted(rs, key=lambda r: r["pos"])] for k, rs in _by(s.collect(), "k").items()} == {k: x.tolist() for k, x in held.items()}
    assert sorted(r["pos"] for r in s.where("k = 'a'").collect()) == list(range(60))
    stats, ac, f = ({r["k"]: r for r in t.collect()} for t in (T.statistics(s, "k"), T.autocorrelations(s, "k"), T.spectrum(s, "k")))
    for k, x in held.items():
        want = _series_features(x[None, :])[0]
        got = [stats[k][c] for c in ("mean", "std", "min", "max", "range", "skew", "kurtosis", "mad")] + [f[k][f"f{i}"] for i in range(4)] + [ac[k][f"ac{g}"] for g in (1, 2, 5, 10)]
        if k != "one":
            assert np.allclose(got[:12], want[:12], atol=1e-9), k
    assert ac["b"]["ac1"] == 0.0 and ac["one"]["ac1"] == 0.0 and f["one"]["f1"] == 0.0
    assert T.statistics(T.positioned(df.limit(0), "k", ["t"], "v"), "k").count() == 0


def _by(rows, key):
    out: dict = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out
