import datetime as dt

import pytest
from common import rows
from pyspark.sql import functions as F

from allelake.functions.decimals import is_decimal, is_whole, one_spelling
from allelake.operators.widen import attributes, widen

WHOLE = {"1": True, "+1": True, "-0": True, "2.0": True, "2.50e1": True, "2.5": False, "1e": False, ".": False, "": False, "1.": True, ".5": False, ".5e1": True, "10e-1": True, "15e-1": False, "0e-9": True, "O7": False, "1 2": False, "9007199254740993.5": False, "1e999999999999999999999": False}


def test_whole_numbers(spark):
    df = spark.createDataFrame([(k,) for k in WHOLE], "x string").select("x", F.coalesce(is_whole(F.col("x")), F.lit(False)).alias("w"))
    assert dict(rows(df)) == WHOLE


def test_one_spelling(spark):
    same = [("1", "1.0", "10e-1", "+1", "001"), ("-2.5", "-25e-1", "-2.50"), ("0", "-0.0", "0e5"), ("100", "1e2", "1.0e+2")]
    for group in same:
        df = spark.createDataFrame([(g,) for g in group], "x string").select(one_spelling(F.col("x")).alias("s"), is_decimal(F.col("x")).alias("d"))
        assert {r["d"] for r in df.collect()} == {True} and len({r["s"] for r in df.collect()}) == 1


TYPES = [("info", "DP", "Integer", "1"), ("info", "AF", "Float", "A"), ("info", "DB", "Flag", "0"), ("fmt", "DP", "Integer", "1"), ("fmt", "FT", "String", "1"), ("fmt", "AD", "Integer", ".")]


def cells(spark, data):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, *d, t + dt.timedelta(seconds=i)) for i, d in enumerate(data)], "cell_id long, row_id long, blob_name string, attr string, cell_value string, loaded_at timestamp")


def test_values_and_issues(spark):
    types = spark.createDataFrame(TYPES, "blob_name string, attr string, vtype string, num string")
    data = [
        (1, "info", "DP", "12"), (1, "info", " dp ", "+12.0"), (1, "info", "INFO_DP", "12"),  # one value
        (1, "fmt", "DP", "3"), (1, "fmt", "fmt_DP", "4"),  # conflict: the plain name counts
        (2, "info", "DP", "O7"), (2, "info", "DP", "7"), (2, "info", "AF", "0.1,.,2e-1"), (2, "info", "DB", "yes"), (2, "info", "DB", "1"),
        (3, "fmt", "FT", "."), (3, "fmt", "AD", " "), (3, "info", "XX", "1"), (3, "fmt", "AD", None),
        (4, "fmt", "AD", "1,2"), (4, "fmt", "AD", "1,2.0"), (4, "fmt", "FT", "a"), (4, "fmt", "FT", "b"), (None, "info", "DP", "1"), (5, "info", "DP", "9223372036854775807"),
    ]
    got = {r["row_id"]: r for r in widen(cells(spark, data), types, issues=True).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert (got[1]["info_DP"], got[1]["info_DP__conflict"], got[1]["fmt_DP"], got[1]["fmt_DP__conflict"]) == (12, False, 3, True)
    assert (got[2]["info_DP"], got[2]["info_DP__untypable"], got[2]["info_AF"], got[2]["info_DB"], got[2]["info_DB__untypable"]) == (7, True, [0.1, None, 0.2], True, True)
    assert got[3]["fmt_FT"] is None and got[3]["fmt_AD"] is None
    assert (got[4]["fmt_AD"], got[4]["fmt_AD__conflict"], got[4]["fmt_FT"], got[4]["fmt_FT__conflict"]) == ([1, 2], False, "b", True)
    assert got[5]["info_DP"] == 9223372036854775807


def test_empty_tables(spark):
    types = spark.createDataFrame(TYPES, "blob_name string, attr string, vtype string, num string")
    none = cells(spark, [(1, "info", "DP", "1")]).limit(0)
    assert widen(none, types).count() == 0
    assert widen(cells(spark, [(1, "info", "DP", "1")]), types.limit(0)).columns == ["row_id"]
    with pytest.raises(ValueError):
        attributes(types, most=2)
