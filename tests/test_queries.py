"""Every registered query runs on the smallest tables and agrees with its SQL."""

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_sql import TABLES, rows

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return c


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, ROOT)
    got = [tuple(r) for r in df.collect()]
    assert got
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, cur.fetchall())
