import random

from common import rows

from allelake.operators import intervals, ranges
from allelake.operators.intervals import periods_and_gaps


def brute(data, max_gap):
    out = []
    by = {}
    for e, s, t in data:
        if s is not None and t is not None and t >= s:
            by.setdefault(e, set()).update(range(s, t + 1))
    for e, covered in by.items():
        spans = []
        for p in sorted(covered):
            if spans and spans[-1][1] == p - 1:
                spans[-1][1] = p
            else:
                spans.append([p, p])
        out += [(e, "period", a, b) for a, b in spans]
        out += [(e, "gap", a[1] + 1, b[0] - 1) for a, b in zip(spans, spans[1:]) if b[0] - a[1] - 1 <= max_gap]
    return sorted(out, key=repr)


def test_against_brute_force_with_ranges_of_hot_entities(spark, monkeypatch):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", "", None]), s := rng.randrange(600), s + rng.choice([-1, 0, 1, 2, 3, 40])) for _ in range(500)]
    data += data[:50] + [("a", None, 3), ("a", 3, None)]
    df = spark.createDataFrame(data, "e string, s int, t int")
    real = ranges.range_cuts
    cut = []
    monkeypatch.setattr(intervals, "range_cuts", lambda *a: cut.append(real(*a[:3], 6, 10)) or cut[-1])
    got = rows(periods_and_gaps(df, ["e"], "s", "t", 5))
    assert got == brute(data, 5)
    assert cut[0].count() >= 1 and len(cut[0].where("e0 = 'hot'").first()["__cuts"]) > 2


def test_search_of_many_cuts_in_two_steps(spark):
    from pyspark.sql import functions as F

    cuts = spark.createDataFrame([("x", list(range(10, 10_000, 10)))], "e string, __cuts array<bigint>")
    df = spark.range(0, 10_100, 7).select(F.lit("x").alias("e"), F.col("id").alias("p"))
    got = ranges.with_range(df, cuts, ["e"], "p").collect()
    assert all(r["__range"] == min(r["p"] // 10, 999) for r in got)


def test_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, 2, "x", 9)], "s int, t int, e0 string, island int")
    assert rows(periods_and_gaps(df, ["e0"], "s", "t")) == [("x", "period", 1, 2)]
    assert periods_and_gaps(df.limit(0), ["e0"], "s", "t").count() == 0
