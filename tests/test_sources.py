"""Run directories, loaders, history, fingerprints, hooks: what the queries don't show."""

from __future__ import annotations

import json

import numpy as np
import pytest

from pointloom.operators import neighbors as N
from pointloom.operators import relational as R
from pointloom.operators.cards import extremes, mutator_fingerprint, priors, row_fingerprint
from pointloom.operators.clustering import base
from pointloom.operators.clustering import kernels as U
from pointloom.operators.clustering.mixtures import fourier
from pointloom.operators.clustering.partition import reachability, xi_valleys
from pointloom.sources import sinks
from pointloom.sources.generators import DataSpec, draw
from pointloom.sources.loaders import load_points


def test_a_missing_parquet_table_falls_back_to_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    df.write.csv(f"{tmp_path}/results.csv", header=True)
    assert sorted(r["n"] for r in sinks.read_results(spark, str(tmp_path)).collect()) == [1, 2]


def test_an_object_is_no_array(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}')
    with pytest.raises(ValueError, match="array"):
        sinks.read_rows(spark, f"{tmp_path}/x.json")
    (tmp_path / "y.json").write_text(' [{"a": 1}, {"a": 2}]')
    assert sinks.read_rows(spark, f"{tmp_path}/y.json").count() == 2


def test_reports(spark, tmp_path):
    small = spark.createDataFrame([(1, [0.5])], "n int, v array<double>")
    sinks.write_report(spark, {"gaps": small, "none": small.limit(0)}, f"{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"gaps": [{"n": 1, "v": [0.5]}], "none": []}
    with pytest.raises(ValueError, match="more than"):
        sinks.write_report(spark, {"gaps": spark.range(11).toDF("n")}, f"{tmp_path}/s.json", 10)


def test_loaders(spark, tmp_path):
    rows = [(float(i), float(i % 7), "b" if i % 3 else "a") for i in range(60)]
    spark.createDataFrame(rows, "u double, v double, target string").write.parquet(f"{tmp_path}/wine.parquet")
    points, source = load_points(spark, "wine", DataSpec(0, 0, 2, outliers=3, noise=2), str(tmp_path))
    assert source.endswith("wine.parquet") and points.count() == 65
    assert {r["label_true"] for r in points.select("label_true").distinct().collect()} == {-1, 0, 1}
    (tmp_path / "heart.tsv").write_text("1\t0.5\t0.25\n-1\tNaN\t0.5\n1\t1\t2\n")
    points, _ = load_points(spark, "heart", DataSpec(0, 0, 2), str(tmp_path))
    got = sorted((r["label_true"], list(r["x"])) for r in points.collect())
    assert got == [(0, [0.0, 0.5]), (1, [0.5, 0.25]), (1, [1.0, 2.0])]
    points, source = load_points(spark, "iris", DataSpec(150, 4, 3), str(tmp_path))
    assert source == "generated" and points.count() == 150
    with pytest.raises(KeyError):
        load_points(spark, "no such table", DataSpec(10, 2, 2))


def test_neighbours_in_reach_are_all_neighbours(spark):
    """Small blocks, so that many are left out, against all distances; with repeated points and a lonely one."""
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (8, 0), (0, 8))] + [np.full((30, 2), 3.0), [[50.0, 50.0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, x array<double>")
    d = np.round(N.distances(x, x), 9)
    np.fill_diagonal(d, np.inf)
    want = {(i, j, k + 1) for i in range(len(x)) for k, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:4])}
    assert {(r["i"], r["j"], r["rk"]) for r in N.knn(df, 4, block=16).collect()} == want
    assert {(r["i"], r["j"]) for r in N.within(df, 0.4, block=16).collect()} == set(zip(*np.nonzero(d <= 0.4), strict=True))
    cells = N.Cells(df, 16)
    assert cells.table.count() > 10 and cells.visits(0.4).count() < cells.table.count() ** 2 / 2
    assert N.knn(df.limit(0), 3).count() == 0 and N.within(df.limit(1), 1.0).count() == 0


def test_the_knee_does_not_hang_on_the_ranges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = np.round(np.concatenate([rng.uniform(0, 1, 400), rng.uniform(1, 30, 40)]), 3)
    df = spark.createDataFrame([(i, float(d)) for i, d in enumerate(v)], "i long, d double").repartition(3)
    whole = N.knee(df, "d").first()["eps"]
    monkeypatch.setattr(N, "CURVE", 50)
    assert N.knee(df, "d").first()["eps"] == whole
    s = np.sort(v)
    gap = np.round(np.abs((s - s[0]) / (s[-1] - s[0]) - np.arange(len(s)) / (len(s) - 1)), 9)
    assert whole == s[gap.argmax()]
    flat = spark.createDataFrame([(i, 2.0) for i in range(5)], "i long, d double")
    assert N.knee(flat, "d").first()["eps"] == pytest.approx(2.0 + 1e-6)


def test_long_episodes(spark):
    """Fifty thousand steps, whose last discount is zero in doubles."""
    df = spark.range(50_000).selectExpr("'run' as run", "id as t", "cast(id % 3 as double) as reward")
    got = {r["t"]: r["return_to_go"] for r in R.discounted_to_go(df, ["run"], "t", "reward", 0.95).where("t in (0, 49998, 49999)").collect()}
    ahead = 0.0
    for t in range(49_999, -1, -1):
        ahead = t % 3 + 0.95 * ahead
    assert got[0] == pytest.approx(ahead) and got[49_999] == 49_999 % 3 and got[49_998] == pytest.approx(49_998 % 3 + 0.95 * (49_999 % 3))


def test_fingerprints_of_parameters(spark):
    df = spark.createDataFrame([("moons", 100, 4, 2, 0.5, 10, 0, 0.5), ("none such", 1, None, None, None, None, None, None), (None, 10**6, 50, 3, 1.0, 0, 1, 1.0)], "dataset string, n_samples int, n_features int, k_target int, compactness double, outliers int, noise int, density double")
    known = {r["dataset"]: r for r in row_fingerprint(df, priors(spark)).collect()}
    assert known["moons"]["conv_cv"] == 0.85 and known["moons"]["eff_dim"] == 2.0 and known["none such"]["conv_cv"] == 0.5
    other = {r["dataset"]: r for r in mutator_fingerprint(df).collect()}
    assert other["moons"]["conv_cv"] == pytest.approx(0.5) and other["moons"]["outlier_frac"] == 1.0 and other["moons"]["eff_dim"] == 4.0
    assert other[None]["log_n"] == pytest.approx(1.2) and other[None]["conv_cv"] == pytest.approx(0.4)


def test_extremes_name_each_row_once(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(7)], "name string, v double")
    got = sorted((r["name"], r["side"]) for r in extremes(df, "name", "v", 5).collect())
    assert got == [(str(i), "lowest" if i < 5 else "highest") for i in range(7)]


def test_valleys_of_a_reachability_plot():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.2, (50, 2)) for c in ((0, 0), (20, 0))])
    order, r, before = reachability(x, 5)
    assert sorted(order.tolist()) == list(range(100)) and np.isinf(r[0]) and np.isfinite(r[1:]).all()
    d = np.sqrt(U.sq_dists(x, x))
    core = np.sort(d, axis=1)[:, 4]
    for at in range(1, 100):  # each was reached from the one before it that reached it at least cost
        i = order[at]
        assert r[at] == pytest.approx(min(max(core[j], d[i, j]) for j in order[:at]))
    assert all(b < a for a, b in enumerate(before.tolist()) if a)
    plot = np.array([np.inf, 1.0, 1.0, 1.0, 1.0, 1.0, 9.0, 1.0, 1.0, 1.0, 1.0, 1.0])
    assert xi_valleys(plot, np.arange(-1, 11), 0.05, 3, 3) == [(0, 5), (6, 11), (0, 11)]  # the whole plot is a valley, too, between two infinite walls


def test_sparse_and_dense_laplacians_agree():
    x, _ = draw("moons", DataSpec(900, 2, 2, 0.5, 1))
    links = U.knn_links(x.astype(float), 10)
    assert np.allclose(links.dense(), U.knn_affinity(x.astype(float), 10))
    few, v = U.laplacian_vectors(links, 5)
    all_, w = U.laplacian_vectors(links.dense(), 5)
    assert np.allclose(few, all_, atol=1e-6)
    assert np.linalg.svd(v.T @ w)[1].min() > 0.99 or all_[4] - all_[3] < 1e-4


def test_a_users_basis():
    x, y = draw("blobs", DataSpec(300, 4, 3, 0.5, 1))
    asked = []

    def basis(x, k, rng):
        asked.append(k)
        return fourier(x, 8, 2, rng)

    fit = base.run("fmm", x, 3, 1, basis=basis)
    assert asked == [3] and fit.extra["feature_dim"] == 16 and fit.steps[0].action["type"] == "user_basis"
    coordinates = base.run("amm", x, 3, 1, basis=lambda z, k, rng: (z[:, :3], np.zeros(3)))
    assert U.ari(y, coordinates.labels) > 0.8


def test_history_makes_routers_choose():
    rng = np.random.default_rng(0)
    from pointloom.operators.clustering import fingerprints as P

    history = []
    for i in range(30):
        x, _ = draw("moons" if i % 2 else "blobs", DataSpec(150, 2, 2, 0.5, i))
        fp = P.fingerprint(x.astype(float), 2, rng, 4, {})
        history.append((fp, {"spectral": 0.9 if i % 2 else 0.1, "kmeans": 0.2 if i % 2 else 0.8, "gmm": 0.5}))
    for version in ("learned_router", "learned_router_v2", "learned_router_v3", "learned_router_v4", "learned_router_v5", "learned_router_v7"):
        for name, want in (("moons", "spectral"), ("blobs", "kmeans")):
            x, _ = draw(name, DataSpec(150, 2, 2, 0.5, 77))
            assert base.run(version, x, 2, 1, history=history).extra["routed_to"] == want, (version, name)


def test_staging_refuses_a_folder_of_one_machine():
    from pointloom.operators.staging import shared_dir

    class Session:
        class sparkContext:
            master = "spark://somewhere:7077"

        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}.get(key, default)

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session)


def test_a_scope_leaves_nothing_behind(spark):
    from pathlib import Path

    from pointloom.operators.staging import scope, stage

    kept = stage(spark.range(3), "kept")
    with scope(spark):
        gone = stage(spark.range(5), "gone")
        assert gone.count() == 5
    assert kept.count() == 3
    folder = Path(kept._pl_path.removeprefix("file://")).parent
    assert not Path(gone._pl_path.removeprefix("file://")).exists() and any(folder.iterdir())


def test_matrices_and_the_dashboard(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(3, 2))
    np.save(tmp_path / "b.npy", np.arange(4))
    got = {(r["path"][-5:], r["point_id"]): list(r["x"]) for r in sinks.read_matrix(spark, f"{tmp_path}/*.npy").collect()}
    assert got["a.npy", 2] == [4.0, 5.0] and got["b.npy", 3] == [3.0] and len(got) == 7
    df = spark.createDataFrame([("kmeans", float("nan"), "1.5", 9), ("gmm", 0.5, "none", 9)], "algo string, ari double, compactness string, other int")
    assert sorted(map(tuple, sinks.dashboard(df).collect())) == [("gmm", 0.5, None), ("kmeans", None, 1.5)]
