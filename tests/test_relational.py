"""Relational operators on hand-computed fixtures."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pointloom.operators import relational as R


@pytest.fixture(scope="module")
def ranks(spark):
    rows = [(s, a, v + 0.01 * s) for s in range(4) for a, v in (("a", 0.90), ("b", 0.80), ("c", 0.85))]
    return spark.createDataFrame(rows, "seed int, algo string, ari double")


@pytest.mark.parametrize(("higher", "expected"), [(True, {"a": 1.0, "b": 3.0, "c": 2.0}), (False, {"a": 3.0, "b": 1.0, "c": 2.0})])
def test_average_ranks_and_friedman(ranks, higher, expected):
    assert {r["algo"]: r["avg_rank"] for r in R.average_ranks(ranks, "ari", ["seed"], higher=higher).collect()} == expected
    f = R.with_chi_square_p(R.friedman(ranks, "ari", ["seed"], higher=higher).withColumn("df", F.col("k") - 1), "statistic", "df").first()
    assert (f["n"], f["k"], round(f["statistic"], 9), round(f["p"], 6)) == (4, 3, 8.0, 0.018316)


def test_friedman_without_complete_tasks_or_with_two_algorithms(spark, ranks):
    holes = ranks.where("not (algo = 'a' and seed < 4 and seed >= 0)").unionByName(spark.createDataFrame([(9, "a", 0.5)], ranks.schema))
    assert R.friedman(holes, "ari", ["seed"]).first()["statistic"] is None
    assert R.friedman(ranks.where("algo <> 'c'"), "ari", ["seed"]).first()["statistic"] is None


def test_ties_share_a_rank_and_missing_values_none(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "b", 5.0), (1, "c", 3.0), (1, "d", None), (1, "e", float("nan")), (None, "a", 1.0), (None, "b", 1.0)], "t int, algo string, v double")
    got = {(r["t"], r["algo"]): r["rank"] for r in R.task_ranks(df, "v", ["t"]).collect()}
    assert got == {(1, "a"): 1.5, (1, "b"): 1.5, (1, "c"): 3.0, (None, "a"): 1.5, (None, "b"): 1.5}


def test_chi_square_tail():
    assert math.isclose(R.chi_square_survival(8.0, 2), math.exp(-4), rel_tol=1e-12)
    assert R.chi_square_survival(0.0, 3) == 1.0
    assert math.isclose(R.chi_square_survival(3.841458820694124, 1), 0.05, rel_tol=1e-9)


def test_returns_to_go(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.0), (1, 2, 2.0)], "e int, t int, r double")
    got = [round(r["return_to_go"], 9) for r in R.discounted_to_go(df, ["e"], "t", "r", 0.95).orderBy("t").collect()]
    assert got == [2.805, 1.9, 2.0]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 7.0), ("c", None)], "g string, v double")
    assert {r["g"]: r["m"] for r in df.groupBy("g").agg(R.upper_median("v").alias("m")).collect()} == {"a": 3.0, "b": 7.0, "c": None}


def test_upsert_matches_null_keys(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", 2, 2), ("c", 3, 3)], "k string, j int, v int")
    new = spark.createDataFrame([("a", None, 10), ("d", 4, 40)], "k string, j int, v int")
    assert sorted((r["k"], r["v"]) for r in R.upsert(old, new, ["k", "j"]).collect()) == [("a", 10), ("b", 2), ("c", 3), ("d", 40)]
    assert R.upsert(old.limit(0), new, ["k", "j"]).count() == 2


def test_flatten_renames_what_clashes(spark):
    df = spark.createDataFrame([(1, 0.5, (0.9, 0.1))], "id int, compactness double, metrics struct<ari: double, compactness: double>")
    assert R.flatten(df, "metrics", ["compactness"]).columns == ["id", "compactness", "ari", "metric_compactness"]


def test_grid_is_the_product_in_order(spark):
    rows = [(r["row_number"], r["a"], r["b"]) for r in R.expand_grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]}).orderBy("row_number").collect()]
    assert rows == [(0, 1, "x"), (1, 1, "y"), (2, 1, "z"), (3, 2, "x"), (4, 2, "y"), (5, 2, "z")]


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_nearest_takes_the_smallest_of_equals(spark, block):
    q = spark.createDataFrame([(1, 0.0), (2, 10.0)], "q int, v double")
    t = spark.createDataFrame([(7, 1.0), (5, -1.0), (9, 9.0)], "t int, v double")
    got = {r["q"]: (r["t"], r["distance"]) for r in R.nearest(q, t, ["v"], "q", "t", {"v": 2.0}, block).collect()}
    assert got == {1: (5, 0.5), 2: (9, 0.5)}


def test_min_max_and_weighted_mean(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, 1.0), ("m", None, 5.0), ("c", 4.0, 1.0), ("c", 4.0, 1.0)], "g string, v double, w double")
    got = sorted((r["g"], r["s"]) for r in R.min_max(df, ["g"], "v", "s").where("s is not null").collect())
    assert got == [("c", 1.0), ("c", 1.0), ("m", 0.0), ("m", 1.0)]
    assert {r["g"]: r["x"] for r in df.groupBy("g").agg(R.weighted_mean("v", "w").alias("x")).collect()} == {"m": 5 / 3, "c": 4.0}


def test_last_wins_map(spark):
    df = spark.createDataFrame([(1, "a", 0.1, 1), (1, "a", 0.2, 2), (1, "b", float("nan"), 3)], "t int, algo string, v double, o int")
    assert R.last_wins_map(df, ["t"], "algo", "v", "o").first()["by_name"] == {"a": 0.2}


def test_upsert_query_covers_all_seeds(spark, monkeypatch):
    from pointloom.plans import relational_queries as Q

    rows = [(s, "kmeans", "blobs", s, 3) for s in (1, 15, 30, 31, 500)]
    monkeypatch.setattr(Q, "runs", lambda *_: spark.createDataFrame(rows, "result_id long, algo string, dataset string, seed int, k_target int"))
    got = {r["seed"]: r["result_id"] for r in Q.results_upsert(spark, "").collect()}
    assert got == {1: 1, 15: 1_000_015, 30: 1_000_030, 31: 1_000_031, 500: 1_000_500}


def test_returns_of_a_long_episode(spark):
    n = 40_000
    df = spark.range(n).select(F.lit(1).alias("e"), F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("r")).unionByName(spark.sql("select 2 e, 0L t, 5.0D r"))
    got = {(r["e"], r["t"]): r["return_to_go"] for r in R.discounted_to_go(df, ["e"], "t", "r", 0.95).collect()}
    want = 0.0
    for t in range(n - 1, -1, -1):
        want = t % 7 + 0.95 * want
        assert math.isclose(got[1, t], want, rel_tol=1e-12)
    assert got[2, 0] == 5.0 and len(got) == n + 1


def test_returns_query_keeps_long_runs(spark, monkeypatch):
    from pointloom.plans import relational_queries as Q

    monkeypatch.setattr(Q, "_steps", lambda *_: spark.range(300).selectExpr("'a' run_id", "int(id) step_idx", "-1.0D delta_cost"))
    assert Q.returns_to_go(spark, "").count() == 300


def test_flat_tables_keep_rows_with_nan(spark, monkeypatch):
    from pointloom.plans import relational_queries as Q

    df = spark.createDataFrame([(1, "kmeans", 1.0, float("nan"), 0.5, 2.0), (2, "gmm", 1.0, 0.1, None, float("nan"))], "result_id long, algo string, compactness double, ari double, nmi double, metric_compactness double")
    monkeypatch.setattr(Q, "table", lambda *_: df)
    got = sorted(tuple(r) for r in Q.results_flatten(spark, "").collect())
    assert got == [(1, "kmeans", 1.0, None, 0.5, 2.0), (2, "gmm", 1.0, 0.1, None, None)]
