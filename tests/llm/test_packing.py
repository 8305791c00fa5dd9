from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from allelake.llm.packing import Windows, merge_plan, pack, pack_texts


@given(st.lists(st.integers(0, 50), max_size=300), st.integers(1, 8))
@settings(max_examples=100, deadline=None)
def test_windows_never_overflow(sizes, open_):
    w = Windows(50, open_)
    fill = Counter()
    for s in sizes:
        fill[w.place(s)] += s
    assert all(f <= 50 for f in fill.values())
    left = w.left()
    assert len(left) <= open_ and all(fill[i] == f for i, f in left)


@given(st.lists(st.integers(0, 50), max_size=100))
@settings(max_examples=100, deadline=None)
def test_merging_keeps_the_capacity(fills):
    total = Counter()
    for f, c in zip(fills, merge_plan(fills, 50)):
        total[c] += f
    assert all(t <= 50 for t in total.values())


def test_pack_wastes_little_and_keeps_rows(spark):
    df = spark.range(20_000, numPartitions=7).select("id", (F.pmod(F.xxhash64("id"), 700) + 1).cast("int").alias("size"))
    got = pack(df, "size", 2048).toPandas()
    assert sorted(got["id"]) == list(range(20_000))
    fill = got.groupby("container_id")["size"].sum()
    assert fill.max() <= 2048 and fill.sum() / (len(fill) * 2048) > 0.98


def test_texts_come_out_in_one_place(spark):
    texts = [(i, ("word " * (i % 90 + 1)).strip()) for i in range(300)] + [(1000, "a long one. " * 400), (1001, ""), (1002, None), (5, "again"), (None, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = pack_texts(df, capacity=256).toPandas()
    assert got.groupby("container_id")["n_tokens"].sum().max() <= 256
    pieces = got[got["doc_id"] == 1000].sort_values("piece_no")
    assert len(pieces) > 1 and list(pieces["first_byte"])[1:] == list(pieces["end_byte"])[:-1] and pieces["end_byte"].iloc[-1] == 4800
    others = got[got["doc_id"] != 1000]
    assert len(others) == len(texts) - 1 and (others["piece_no"] == 0).all()
    assert pack_texts(df.limit(0)).count() == 0


def test_refusals(spark):
    with pytest.raises(ValueError):
        Windows(5, 2).place(6)
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 1)], "container_id int, size int"), "size", 5)
    one = spark.createDataFrame([(1, None), (1, None), (2, 5)], "id int, size int")
    assert pack(one, "size", 5).count() == 3
