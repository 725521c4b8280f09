"""Every query that has SQL gives the SQL's rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
# The training-data subpackage has tests of its own.
NAMES = sorted(n for n in entry.engine.QUERIES)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 8) + 0.0
    return value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    frame = entry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    if (sql := entry.oracle_sql().get(name)) is None:
        return
    result = tables.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["queryId", "count", "sum", "avg"]
