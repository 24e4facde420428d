"""Splits: groups stay together and shares are met."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pointloom.llm.splits import allocate, assign_splits, balanced_bins, deal_groups, largest_differencing

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
SCHEMA = "id long, d string, s int, split string, first string, weight string"


@pytest.mark.parametrize("k", [2, 7, 100])
def test_bins_are_nearly_equal(k):
    rng = np.random.default_rng(k)
    for w in (np.ones(3000), rng.integers(1, 50, 3000), rng.pareto(1.5, 3000).astype(int) + 1):
        sums = np.bincount(deal_groups(w, k), weights=w, minlength=k)
        assert sums.sum() == w.sum()
        rest = np.sort(sums)[: k - int((w > w.sum() / k).sum())]
        assert rest.max() - rest.min() <= max(3.0, 0.05 * w.sum() / k)


def test_a_giant_has_a_bin_of_its_own():
    w = np.array([5000] + [1] * 990)
    slots = deal_groups(w, 100)
    assert (slots == slots[0]).sum() == 1


def test_rows_keep_their_entries_apart():
    rows = [np.array([5.0, 3.0, 0.0]), np.array([4.0, 1.0, 1.0]), np.array([9.0, 0.0, 0.0])]
    got, single = largest_differencing(rows, np.array([2.0]), 3)
    for row, slots in zip(rows, got, strict=True):
        used = slots[row > 0]
        assert len(set(used)) == len(used) and (used >= 0).all() and (slots[row == 0] == -1).all()
    sums = np.zeros(3)
    for row, slots in zip(rows, got, strict=True):
        np.add.at(sums, slots[row > 0], row[row > 0])
    sums[single[0]] += 2
    assert sums.max() <= 10


def test_fewer_groups_than_bins():
    assert len(set(deal_groups(np.array([3, 2, 1]), 10).tolist())) == 3
    assert len(deal_groups(np.array([], dtype=int), 10)) == 0


def test_allocation_meets_shares():
    got = allocate({i: 10 for i in range(100)}, SHARES)
    assert {s: sum(1 for v in got.values() if v == s) for s in SHARES} == {"train": 80, "validation": 10, "test": 10}
    assert allocate({}, SHARES) == {}
    assert set(allocate({0: 5, 1: 1}, {"a": 1, "b": 0}).values()) == {"a"}


def _rows(n, seed):
    rng = random.Random(seed)
    return [(i, None if rng.random() < 0.05 else "hot" if rng.random() < 0.3 else f"d{rng.randrange(300)}", rng.choice([1, 2, None]), "x", "y", "z") for i in range(n)]


@pytest.mark.parametrize("per_task", [20, 20_000])
def test_groups_stay_together(spark, per_task, monkeypatch):
    import pointloom.llm.splits as S

    monkeypatch.setattr(S.balanced_bins, "__defaults__", (S.BINS, per_task))
    rows = _rows(4000, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["id"]: (r["first"], r["split"]) for r in assign_splits(df, "id", ["d", "s"], SHARES, bins=50).collect()}
    assert len(got) == 4000
    groups: dict = {}
    for r in rows:
        groups.setdefault((r[1], r[2]), []).append(r[0])
    for ids in groups.values():
        assert {got[i] for i in ids} == {(min(ids), got[ids[0]][1])}
    share = {s: sum(1 for _, v in got.values() if v == s) / 4000 for s in SHARES}
    assert all(abs(share[s] - SHARES[s]) < 0.02 for s in SHARES)
    again = {r["id"]: r["split"] for r in assign_splits(df.repartition(3), "id", ["d", "s"], SHARES, bins=50).collect()}
    assert again == {i: v for i, (_, v) in got.items()}


def test_many_buckets_are_combined(spark):
    df = spark.createDataFrame([(i, 1 + i % 9) for i in range(3000)], "g long, w int")
    rows = balanced_bins(df, "g", "w", 20, 50).collect()
    assert len(rows) == 3000
    sums = np.bincount([r["bin"] for r in rows], weights=[r["weight"] for r in rows], minlength=20)
    assert sums.max() - sums.min() <= 3


def test_empty_table(spark):
    assert assign_splits(spark.createDataFrame([], SCHEMA), "id", ["d", "s"], SHARES).count() == 0


def test_columns_named_like_results(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2, 7) for i in range(30)], "first long, split int, weight int, bin int")
    rows = assign_splits(df.withColumnRenamed("first", "group"), "group", ["split", "weight"], SHARES).collect()
    assert len(rows) == 30 and all(r["first"] == r["group"] % 6 for r in rows)


def test_records_that_share_an_author_or_a_source(spark):
    """Components of records that agree in either of two links, against a loop; null binds nothing."""
    from pointloom.llm.splits import related_records

    rng = random.Random(4)
    rows = [(i, f"a{rng.randrange(150)}" if rng.random() < 0.7 else None, rng.randrange(200) if rng.random() < 0.7 else None, "hot" if i % 3 == 0 and i < 90 else None, "y", "z") for i in range(400)]
    home = list(range(400))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    seen: dict = {}
    for r in rows:
        for link, value in (("d", r[1]), ("s", r[2]), ("split", r[3])):
            if value is not None:
                a, b = root(seen.setdefault((link, value), r[0])), root(r[0])
                home[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    links = [["d"], ["s"], ["split"]]
    assert {r["id"]: r["first"] for r in related_records(df, "id", links).collect()} == {i: root(i) for i in range(400)}
    got = {r["id"]: (r["first"], r["split"]) for r in assign_splits(df, "id", links, SHARES, bins=20).collect()}
    assert {i: f for i, (f, _) in got.items()} == {i: root(i) for i in range(400)}
    assert all(got[i][1] == got[got[i][0]][1] for i in got)
    assert related_records(df.limit(0), "id", links).count() == 0
