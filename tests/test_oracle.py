"""Every registered query against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns, got = table(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:  # compared elsewhere; here it has rows, and no column is empty throughout
        assert got, name
        assert all(any(r[i] is not None for r in got) for i in range(len(columns))), columns
        return
    cursor = duck.execute(sql)
    want_columns, want = table([d[0] for d in cursor.description], cursor.fetchall())
    want = [tuple(float(v) if isinstance(v, decimal.Decimal) else v for v in r) for r in want]
    assert columns == want_columns
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
