"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import compare

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert ok, note


def test_entry(spark):
    got = entry.entry(spark).collect()
    assert {r["status"] for r in got} <= {"answered", "no_answer", "failed"}
    assert got
