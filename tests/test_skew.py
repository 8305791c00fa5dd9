import pandas as pd
from common import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from allelake.operators.skew import BIN, SHARD, TOKEN, balanced_aggregate, balanced_apply, fragment, fragment_replicate_join, pack, plan_load


@given(st.lists(st.integers(1, 1000), max_size=20), st.integers(1, 12))
@settings(max_examples=50, deadline=None)
def test_pack_gives_every_key_a_bin_and_cuts_in_proportion(loads, tasks):
    total = sum(loads)
    bins = pack([((i,), n) for i, n in enumerate(loads)], tasks, total)
    for i, n in enumerate(loads):
        assert bins[(i,)] and all(0 <= b < tasks for b in bins[(i,)])
        assert n / len(bins[(i,)]) <= max(1, total / tasks) + 1e-9


def skewed(spark):
    return spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.col("id") % 10).alias("v"))


def test_aggregate_equals_plain(spark):
    df = skewed(spark)
    got = balanced_aggregate(df, ["k"], [F.count("*").alias("n"), F.sum("v").alias("s")], [F.sum("n").alias("n"), F.sum("s").alias("s")], plan_load(df, ["k"], 8))
    assert rows(got) == rows(df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")))


def test_hot_key_is_spread_evenly(spark):
    df = skewed(spark)
    plan = plan_load(df, ["k"], 8)
    assert plan.shards()[("hot",)] >= 2
    loads = [r[1] for r in fragment(df, plan).groupBy("__bin").count().collect()]
    assert max(loads) <= 2 * 1000 / 8


def test_apply_median_per_key(spark):
    df = skewed(spark).where("k is not null")
    def shard(p):
        return p.groupby(["k", "v"]).size().rename("c").reset_index()
    def merge(p):
        g = p.groupby("v")["c"].sum().sort_index().cumsum()
        return pd.DataFrame({"k": p["k"].iloc[:1], "median": [int(g.index[(g * 2 >= g.iloc[-1]).argmax()])]})
    got = dict(rows(balanced_apply(df, ["k"], shard, "k string, v long, c long", merge, "k string, median long", plan_load(df, ["k"], 4))))
    want = df.toPandas().groupby("k")["v"].quantile(0.5, interpolation="lower").to_dict()
    assert got == {k: int(v) for k, v in want.items()}


def test_join_equals_plain_with_clashing_names(spark):
    df = skewed(spark)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left", "leftsemi", "leftanti"):
        got = fragment_replicate_join(df, right, ["k"], how, plan_load(df, ["k"], 8))
        want = df.join(right.withColumnRenamed("v", "v_right"), "k", how)
        assert rows(got, *sorted(got.columns)) == rows(want, *sorted(want.columns))


def test_empty_table(spark):
    df = skewed(spark).limit(0)
    assert balanced_aggregate(df, ["k"], [F.count("*").alias("n")], [F.sum("n").alias("n")]).count() == 0


def test_rows_and_partial_rows_are_in_their_planned_bin(spark):
    df = skewed(spark)
    plan = plan_load(df, ["k"], 8, one_in=1)
    placed = fragment(df, plan)
    direct = placed.repartitionById(8, BIN).where(F.spark_partition_id() != F.col(BIN))
    assert direct.count() == 0
    planned = placed.join(plan.heavy.where("k is not null"), "k", "left_semi").where(F.col(TOKEN) > 0)
    by_token = planned.repartition(8, "k", SHARD, TOKEN).where(F.spark_partition_id() != F.col(BIN))
    assert planned.count() > 300 and by_token.count() == 0
    loads = [r[1] for r in placed.groupBy(BIN).count().collect()]
    assert len(loads) == 8 and max(loads) <= 1.3 * 1000 / 8


def test_join_and_apply_shuffle_each_side_once(spark):
    df = skewed(spark)
    plan = plan_load(df, ["k"], 8)
    right = spark.range(5000).select(F.concat(F.lit("k"), F.col("id") % 50).alias("k"), F.col("id").alias("w"))
    text = fragment_replicate_join(df, right, ["k"], plan=plan)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange shufflepartitionidpassthrough") == 2 and "Exchange hashpartitioning" not in text
