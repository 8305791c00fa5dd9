"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(FOLDER + "/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cursor.description]
    assert sorted(cols) == sorted(got.columns)
    assert Counter(tuple(plain(r[c]) for c in cols) for r in got.collect()) == Counter(tuple(map(plain, r)) for r in cursor.fetchall())
