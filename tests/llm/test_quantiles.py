"""Percentile summaries: exact while small, within their bound when large, the same however they are combined."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pointloom.llm.quantiles import Summary, combine, percentiles, quantiles, summarise

PERMILLE = (500, 900, 950, 990)


def _check(values, packed, buffer):
    n, error, sizes, body = packed
    assert n == len(values) == sum(s << h for h, s in enumerate(sizes))
    order = np.sort(values)
    for q, v in zip(PERMILLE, quantiles(n, sizes, body, PERMILLE), strict=True):
        rank = max(1, -(-n * q // 1000))
        low, high = np.searchsorted(order, v, side="left") + 1, np.searchsorted(order, v, side="right")
        assert low - error <= rank <= high + error
    assert error <= n * max(0, np.log2(max(n / buffer, 1)) + 1) / (2 * buffer)


@pytest.mark.parametrize("n", [1, 7, 64, 127, 128, 129, 1000, 50_000])
@pytest.mark.parametrize("kind", ["random", "sorted", "equal", "heavy"])
def test_bound(n, kind):
    rng = np.random.default_rng(n)
    values = {"random": rng.random(n), "sorted": np.arange(n, dtype=float), "equal": np.ones(n), "heavy": rng.pareto(1, n)}[kind]
    s = Summary(64)
    for part in np.array_split(values, 7):
        s.add(part)
    _check(values, s.packed(), 64)


def test_merges_in_any_order_stay_within_the_bound():
    rng, parts = np.random.default_rng(0), []
    values = rng.normal(size=30_000)
    for part in np.array_split(values, 40):
        s = Summary(128)
        s.add(part)
        parts.append(s.packed())
    for seed in range(5):
        order = parts[:]
        random.Random(seed).shuffle(order)
        while len(order) > 1:
            s = Summary(128)
            for p in (order.pop(), order.pop(0)):
                s.join(*p)
            order.append(s.packed())
        _check(values, order[0], 128)


def test_production_error_is_below_one_percent():
    values = np.random.default_rng(0).lognormal(size=2_000_000)
    s = Summary()
    for part in np.array_split(values, 50):
        t = Summary()
        t.add(part)
        s.join(*t.packed())
    n, error, _, _ = s.packed()
    assert error / n < 0.01


def test_tables(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(6000):
        v = None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(rng.lognormal())
        rows.append(("hot" if i % 3 else None if i % 2 else "b", i % 10, v, -1.0 if i % 5 else None, i))
    df = spark.createDataFrame(rows, "algo string, day int, a double, b double, n int").repartition(6)
    daily = summarise(df, ["algo", "day"], ["a", "b"], 64)
    for whole in (combine(daily, ["algo"], 64), combine(summarise(df, ["algo", "day"], ["a", "b"], 64, held=10), ["algo"], 64)):
        for r in percentiles(whole).collect():
            v = np.sort([x[2 if r["measure"] == "a" else 3] for x in rows if x[0] == r["algo"] and x[2 if r["measure"] == "a" else 3] is not None and not np.isnan(x[2 if r["measure"] == "a" else 3])])
            assert r["n"] == len(v)
            for q, name in zip(PERMILLE, ("p50", "p90", "p95", "p99"), strict=True):
                rank = -(-len(v) * q // 1000)
                assert v[max(0, rank - 1 - r["rank_error"])] <= r[name] <= v[min(len(v) - 1, rank - 1 + r["rank_error"])]


def test_nothing_to_summarise(spark):
    empty = spark.createDataFrame([], "algo string, day int, a double")
    assert summarise(empty, ["algo", "day"], ["a"]).count() == 0
    nulls = spark.createDataFrame([("x", 1, None), ("x", 1, float("nan")), ("y", None, 2.0)], "algo string, day int, a double")
    rows = percentiles(summarise(nulls, ["algo", "day"], ["a"])).collect()
    assert [(r["algo"], r["day"], r["n"], r["p50"], r["p99"]) for r in rows] == [("y", None, 1, 2.0, 2.0)]


def test_a_key_in_more_tasks_than_a_merge_takes(spark):
    """300 tasks, a few numbers at a time, whatever the session says of shuffle partitions: no merge takes more than the fan-in, and the bound holds."""
    from pyspark.sql import functions as F

    from pointloom.llm.quantiles import FAN_IN, _merged, _partial

    df = spark.range(0, 60_000, 1, 300).select(F.lit("k").alias("algo"), F.pmod(F.col("id") * 7919, F.lit(60_000)).cast("double").alias("a"))
    parts = _partial(df, ["algo"], ["a"], 64, 50)
    assert parts.select("__pl_part").distinct().count() == parts.count() > 2 * FAN_IN
    seen = []
    import pointloom.llm.quantiles as q

    def counted(df, keys, buffer):
        seen.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return _merged(df, keys, buffer)

    q._merged = counted
    try:
        r = percentiles(summarise(df, ["algo"], ["a"], 64, held=50)).first()
    finally:
        q._merged = _merged
    assert len(seen) > 1 and max(seen) <= FAN_IN
    assert r["n"] == 60_000 and r["rank_error"] < 0.2 * 60_000
    for p, name in ((0.5, "p50"), (0.99, "p99")):
        assert abs(r[name] + 1 - p * 60_000) <= r["rank_error"] + 1
