"""Top N per group against sorting."""

from __future__ import annotations

import math
import random

import pytest

from pointloom.llm.topn import score_bin, top_n_per_group

SCHEMA = "g string, s int, v double, algo string, id long, rank_in string"


def _rows(n, seed):
    rng = random.Random(seed)
    values = [0.0, -0.0, 1.0, 1.0, 0.5, None, float("nan"), float("inf"), float("-inf"), 1e300, -1e-300]
    out = []
    for i in range(n):
        g = "hot" if rng.random() < 0.4 else None if rng.random() < 0.1 else f"g{rng.randrange(20)}"
        v = rng.choice(values) if rng.random() < 0.3 else round(rng.uniform(-1, 1), 2)
        out.append((g, rng.randrange(2) if rng.random() < 0.9 else None, v, rng.choice("abc"), i, "x"))
    return out


def _want(rows, n):
    groups = {}
    for r in rows:
        if r[2] is not None and not math.isnan(r[2]):
            groups.setdefault((r[0], r[1]), []).append(r)
    return {(r[4], k + 1) for rs in groups.values() for k, r in enumerate(sorted(rs, key=lambda r: (-(r[2] + 0.0), r[3], r[4]))[:n])}


@pytest.mark.parametrize(("n", "most"), [(3, 100_000), (3, 2), (1, 10), (50, 100_000), (0, 100)])
def test_against_sorting(spark, n, most):
    rows = _rows(1500, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [(r["id"], r["rank"]) for r in top_n_per_group(df, ["g", "s"], "v", n, ["algo", "id"], most).collect()]
    assert len(got) == len(set(got)) and set(got) == _want(rows, n)


@pytest.mark.parametrize(("most", "slots"), [(1, 4), (1, 1 << 18), (5, 16)])
def test_shared_thresholds(spark, most, slots):
    """Groups without a threshold of their own have one all the same, and none loses a row by it."""
    rng = random.Random(slots)
    rows = _rows(1500, 7) + [(f"few{i}", 1, rng.random(), "a", 10_000 + i * 50 + k, "x") for i in range(200) for k in range(rng.randrange(1, 50))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [(r["id"], r["rank"]) for r in top_n_per_group(df, ["g", "s"], "v", 3, ["algo", "id"], most, slots).collect()]
    assert len(got) == len(set(got)) and set(got) == _want(rows, 3)


def test_a_group_of_equal_rows_and_an_empty_table(spark):
    rows = [("one", 1, 0.5, "a", i, "") for i in range(3000)]
    got = [r["id"] for r in top_n_per_group(spark.createDataFrame(rows, SCHEMA), ["g", "s"], "v", 3, ["algo", "id"]).collect()]
    assert sorted(got) == [0, 1, 2]
    assert top_n_per_group(spark.createDataFrame([], SCHEMA), ["g", "s"], "v", 3, ["id"]).count() == 0


def test_bins_never_fall(spark):
    from pyspark.sql import functions as F

    values = sorted([random.Random(1).uniform(-2, 2) for _ in range(3000)] + [0.0, 1e9, -1e9, 1e308, -1e308, float("inf"), float("-inf"), 1e-310])
    bins = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").orderBy("v").select(score_bin(F.col("v"))).collect()]
    assert bins == sorted(bins)
