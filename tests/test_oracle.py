"""Every query that SQL can express, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from shapeloom import queries as own

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_oracle(spark, con, name):
    rows = own.queries()[name](spark, SF)
    cols = sorted(rows.columns)
    got = sorted(map(str, (tuple(r) for r in rows.select(*(f"`{c}`" for c in cols)).collect())))
    sql = ", ".join(f'"{c}"' for c in cols)
    want = sorted(map(str, con.sql(f"select {sql} from ({own.oracle_sql()[name]})").fetchall()))
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
