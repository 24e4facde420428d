"""Runs of like events against a plain loop."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from pointloom.llm.runs import agglomerate, collapse_runs

T0 = datetime(2025, 1, 1)
SCHEMA = "run string, pos int, cost double, delta double, ok boolean, at timestamp, seen timestamp, n long"


def _same(a, b):
    none = lambda v: v is None or math.isnan(v)
    if none(a) or none(b):
        return none(a) and none(b)
    return a == b or (math.isfinite(a) and math.isfinite(b) and abs(a - b) <= 1e-6 * max(1, abs(a)))


def _want(rows, at_least=1, gap=None):
    runs: dict = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and (r[0], r[1]) not in runs or (r[0], r[1]) in runs and r[6] > runs[r[0], r[1]][6]:
            runs[r[0], r[1]] = r
    out, last = [], None
    for key in sorted(runs):
        r = runs[key]
        joined = last is not None and last[0] == r[0] and (last[4] in (None, True)) == (r[4] in (None, True)) and _same(last[2], r[2]) and _same(last[3], r[3])
        if joined and gap is not None:
            joined = (r[5] - last[5]).total_seconds() <= gap
        if joined:
            out[-1] = (out[-1][0], out[-1][1], r[1], out[-1][3] + 1)
        else:
            out.append((r[0], r[1], r[1], 1))
        last = r
    return sorted(o for o in out if o[3] >= at_least)


def _rows(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        cost = rng.choice([1.0, 1.0, 1.0 + 5e-7, 2e6, 2e6 + 1, None, float("nan"), 0.0, -0.0, float("inf")])
        run = None if rng.random() < 0.02 else "hot" if rng.random() < 0.4 else f"r{rng.randrange(8)}"
        pos = None if rng.random() < 0.02 else rng.randrange(-20, 100)
        rows.append((run, pos, cost, rng.choice([0.0, 0.0, None]), rng.choice([True, None, True, False]), T0 + timedelta(seconds=10 * (pos or 0)), T0 + timedelta(seconds=i), i))
    return rows + [r[:6] + (r[6] + timedelta(days=1), r[7]) for r in rows[::5]]


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
@pytest.mark.parametrize("at_least", [1, 2])
def test_against_a_loop(spark, block, at_least):
    from pyspark.sql import functions as F

    rows = _rows(block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    ok = F.coalesce(F.col("ok"), F.lit(True))
    got = collapse_runs(df, "run", "pos", ["cost", "delta"], [ok], "at", "seen", block=block, at_least=at_least).collect()
    assert sorted((r["run"], r["first_pos"], r["last_pos"], r["n"]) for r in got) == _want(rows, at_least)
    assert all(r["duration_s"] == 10.0 * (r["last_pos"] - r["first_pos"]) for r in got)


@pytest.mark.parametrize("level", [2, 3])
def test_levels_of_blocks(spark, level):
    from pyspark.sql import functions as F

    rows = _rows(21) + [("long", i, 5.0 if i < 700 else float(i), 0.0, True, T0 + timedelta(seconds=10 * i), T0, i) for i in range(-300, 1200)]
    ok = F.coalesce(F.col("ok"), F.lit(True))
    got = collapse_runs(spark.createDataFrame(rows, SCHEMA), "run", "pos", ["cost", "delta"], [ok], "at", "seen", block=2, level=level, at_least=2).collect()
    assert sorted((r["run"], r["first_pos"], r["last_pos"], r["n"]) for r in got) == _want(rows, 2)


def _closest_first(values, free, tolerance):
    """Runs of (sum, n, first, last) merged by trying all neighbours again and again."""
    runs = [[v, 1, i, i] for i, v in enumerate(values)]
    while True:
        best = None
        for k in range(1, len(runs)):
            a, b = runs[k - 1], runs[k]
            if free[b[2]]:
                d = abs(b[0] / b[1] - a[0] / a[1]) / max(1.0, abs(a[0] / a[1]))
                if d <= tolerance and (best is None or d < best[0]):
                    best = (d, k)
        if best is None:
            return [r[2] for r in runs]
        k = best[1]
        a, b = runs[k - 1], runs.pop(k)
        runs[k - 1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]


def test_runs_by_likeness_of_runs():
    from pointloom.llm.runs import agglomerate_runs

    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        values, free = np.cumsum(rng.normal(0, 0.05, n)), rng.random(n) < 0.9
        head = agglomerate_runs(free, values[:, None], np.ones(n), 0.1)
        assert np.unique(head).tolist() == _closest_first(values, free, 0.1)


def test_a_drift_ends_a_run_and_a_gap_too(spark):
    rows = [("a", i, i * 0.04, 0.0, True, T0 + timedelta(seconds=i if i < 60 else 5000 + i), T0, i) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    by_event = collapse_runs(df, "run", "pos", ["cost"], ["ok"], "at", "seen", tolerance=0.05).collect()
    by_run = collapse_runs(df, "run", "pos", ["cost"], ["ok"], "at", "seen", tolerance=0.05, max_gap_s=60, likeness="run").collect()
    assert len(by_event) == 1 and len(by_run) > 5 and sum(r["n"] for r in by_run) == 100
    assert 59 in {r["last_pos"] for r in by_run}


def test_gap_limit(spark):
    from pyspark.sql import functions as F

    rows = _rows(9)
    got = collapse_runs(spark.createDataFrame(rows, SCHEMA), "run", "pos", ["cost", "delta"], [F.coalesce(F.col("ok"), F.lit(True))], "at", "seen", max_gap_s=10, block=4)
    assert sorted((r["run"], r["first_pos"], r["last_pos"], r["n"]) for r in got.collect()) == _want(rows, 1, 10)


def test_one_long_run_and_no_events(spark):
    rows = [("r", i, 1.0, None, None, None, None, 0) for i in range(5000)]
    got = collapse_runs(spark.createDataFrame(rows, SCHEMA), "run", "pos", ["cost"], ["ok"], "at", block=64).collect()
    assert [(r["first_pos"], r["last_pos"], r["n"], r["duration_s"]) for r in got] == [(0, 4999, 5000, None)]
    assert collapse_runs(spark.createDataFrame([], SCHEMA), "run", "pos", ["cost"], ["ok"]).count() == 0


def test_the_order_of_merges_does_not_matter():
    rng = np.random.default_rng(0)
    for _ in range(50):
        alike = rng.random(30) < 0.6
        alike[0] = False
        want = np.maximum.accumulate(np.where(~alike, np.arange(30), 0))
        assert (agglomerate(alike, rng.random(30)) == want).all()
    assert len(agglomerate(np.zeros(0, dtype=bool), np.zeros(0))) == 0
