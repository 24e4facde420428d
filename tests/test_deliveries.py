"""Current rows, names and skewed joins on nulls, ties, empty tables and clashing columns."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pointloom.operators.deliveries import current_rows, with_meant
from pointloom.operators.skew import join_by_weight

T = [datetime(2025, 1, d) for d in (1, 2, 3)]
SCHEMA = "id long, ingested_at timestamp, v double, rank string"


def test_latest_row_wins_and_keyless_rows_go(spark):
    rows = [(1, T[0], 1.0, "a"), (1, T[2], 3.0, "c"), (1, T[1], 2.0, "b"), (2, None, 9.0, "x"), (2, T[0], None, None), (None, T[0], 5.0, "n"), (3, T[0], 1.0, "p"), (3, T[0], 2.0, "q")]
    got = {r["id"]: (r["v"], r["rank"]) for r in current_rows(spark.createDataFrame(rows, SCHEMA), "id", ["v", "rank"]).collect()}
    assert got == {1: (3.0, "c"), 2: (None, None), 3: (2.0, "q")}


def test_empty_table(spark):
    assert current_rows(spark.createDataFrame([], SCHEMA), "id", ["v"]).count() == 0


def test_names_in_any_spelling(spark):
    names = spark.createDataFrame([("halo_mix", ["halomix", "Mixed Halo"]), ("halo_mix2", []), ("other", None)], "name string, aliases array<string>")
    asked = ["Halo-Mix ", "\thalo mix", "HALOMIX", "mixed-halo", "halo_mix2", "nobody here", None]
    df = spark.createDataFrame([(i, a, "own") for i, a in enumerate(asked)], "i int, dataset_id string, meant string")
    got = {r["i"]: r["out"] for r in with_meant(df, names, out="out").collect()}
    assert got == {0: "halo_mix", 1: "halo_mix", 2: "halo_mix", 3: "halo_mix", 4: "halo_mix2", 5: "nobody_here", 6: None}


@pytest.mark.parametrize("hot_keys", [1, 3, 10_000])
def test_join_by_weight_equals_a_plain_join(spark, hot_keys):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else ("hot" if i % 3 else f"k{i}")) for i in range(200)], "i int, k string")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.min("i").alias("first"))
    got = sorted((r["i"], r["k"] or "", r["first"]) for r in join_by_weight(rows, keyed, ["k"], "w", 200, hot_keys).collect())
    first = {}
    for r in rows.orderBy("i").collect():
        first.setdefault(r["k"], r["i"])
    assert got == sorted((r["i"], r["k"] or "", first[r["k"]]) for r in rows.collect())
