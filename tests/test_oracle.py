"""Every registered query with SQL gives the rows that DuckDB gives, at the smallest size."""

from __future__ import annotations

import os
from collections import Counter
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
if not Path(SF).is_dir():
    pytest.skip("no test tables", allow_module_level=True)

import sciobs.queries as core  # noqa: E402


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, db, name):
    df = core.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in core.ORACLE_SQL:
        assert rows
        return
    want = db.sql(core.ORACLE_SQL[name])
    columns = want.columns
    assert sorted(columns) == sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in rows)
    assert got == Counter(tuple(map(plain, r)) for r in want.fetchall())
