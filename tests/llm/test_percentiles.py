import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from helpers import rows
from pyspark.sql import functions as F

from allelake.llm.percentiles import combine, exact_percentiles, quantiles, sketches
from allelake.llm.sketch import RankSketch


def rank_error(sketch, values, p):
    xs = np.sort(values)
    rank = max(1, math.ceil(p * len(xs) / 100))
    v = sketch.quantile(p)[1]
    lo, hi = np.searchsorted(xs, v, "left") + 1, np.searchsorted(xs, v, "right")
    return max(0, lo - rank, rank - hi) / (len(xs) - rank + 1)


@pytest.mark.parametrize("order", ["random", "up", "down", "ties"])
def test_error_is_relative_to_the_distance_from_the_top(order):
    x = np.random.default_rng(1).lognormal(0, 2, 300_000)
    x = {"random": x, "up": np.sort(x), "down": -np.sort(-x), "ties": np.round(x)}[order]
    parts = []
    for part in np.array_split(x, 13):
        s = RankSketch()
        s.add(part)
        parts.append(RankSketch.from_bytes(s.to_bytes()))
    whole = parts[0]
    for p in parts[1:]:
        whole.merge(p)
    assert whole.n == len(x) and sum(len(level) << h for h, level in enumerate(whole.levels)) == len(x)
    for p in (1, 25, 50, 90, 99, 99.9, 99.99):
        assert rank_error(whole, x, p) < 0.01
        lo, _, hi = whole.quantile(p, 4)
        assert lo <= np.sort(x)[math.ceil(p * len(x) / 100) - 1] <= hi
    assert len(whole.to_bytes()) < 200_000


@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=200), st.floats(0.1, 100))
@settings(max_examples=100, deadline=None)
def test_small_groups_are_exact(values, p):
    s = RankSketch()
    s.add(np.array(values))
    rank = max(1, math.ceil(p * len(values) / 100))
    assert s.quantile(p) == (sorted(values)[rank - 1],) * 3


def test_groups_days_and_exact_check(spark):
    df = spark.range(60_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 2)).alias("g"), (F.col("id") % 5).cast("string").alias("day"),
        F.when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 13 == 0, None).otherwise(F.pow(F.col("id") % 9973, 1.5)).alias("value"),
    )
    daily = sketches(df, ["g", "day"], "value", section=16)
    whole = combine(daily, ["g"])
    good = df.where("value is not null and not isnan(value)")
    assert rows(whole.select("g", "n")) == rows(good.groupBy("g").agg(F.count("*").alias("n")))
    q = quantiles(whole, (50, 90, 99))
    truth = {(r["g"], p): r[f"q{p}"] for r in good.groupBy("g").agg(*(F.expr(f"percentile_disc({p / 100}) within group (order by value)").alias(f"q{p}") for p in (50, 90, 99))).collect() for p in (50, 90, 99)}
    got = q.collect()
    assert all(r["lower"] <= truth[r["g"], int(r["pct"])] <= r["upper"] for r in got) and len(got) == 9
    exact = exact_percentiles(df, ["g"], "value", q)
    assert {(r["g"], int(r["pct"])): r["exact"] for r in exact.collect()} == truth
    wrong = q.withColumns({"lower": F.col("upper") + 1, "upper": F.col("upper") + 2})  # brackets that don't hold the value
    assert {(r["g"], int(r["pct"])): r["exact"] for r in exact_percentiles(df, ["g"], "value", wrong, small=2).collect()} == truth


def test_empty(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan"))], "g string, value double")
    assert sketches(df, ["g"], "value").count() == 0 and sketches(df.limit(0), ["g"], "value").count() == 0
