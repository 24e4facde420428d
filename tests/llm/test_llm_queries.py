"""Queries of the subpackage that have SQL give what DuckDB gives on the smallest tables; all others run."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from pointloom.llm import registry

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


def plain(v):
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(rows) >= 0
        return
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
