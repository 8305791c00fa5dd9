"""The queries that have SQL, against DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import pytest

from allelake.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(FOLDER + "/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries.QUERIES[name](spark, FOLDER)
    cursor = con.execute(queries.SQL[name])
    cols = [c[0] for c in cursor.description]
    assert sorted(cols) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(cursor.fetchall())
