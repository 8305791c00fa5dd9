"""Continuous periods and gaps of overlapping, nested and gapped intervals.

Method: range-sort by (entity, start); summarise every range's maximum end;
combine the summaries by prefix; rescan each range with the carried maximum to
label islands. Only entities too large for a task have more than one range, so
the summaries and the pieces at range borders are a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelake.operators.ranges import RANGE, range_cuts, with_range
from allelake.session import written


def periods_and_gaps(df: DataFrame, entity: Sequence[str], start: str, end: str, max_gap: int | None = None, tasks: int | None = None) -> DataFrame:
    """One row per maximal covered stretch (``period``) and per gap between neighbours (``gap``).

    Positions are inclusive integers; adjoining intervals join. Columns: the
    entity's, ``span_kind``, ``first_pos``, ``last_pos`` (longs). Gaps longer than
    ``max_gap`` are left out; None keeps all.

    Rows with a null start or end, or an end before the start, are left out. A
    null entity value is a value like any other. Repeated rows change nothing. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    entity = list(entity)
    rows = df.select(*(F.col(c).alias(f"e{i}") for i, c in enumerate(entity)), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("t")).where("s is not null and t is not null and t >= s")
    ids = [f"e{i}" for i in range(len(entity))]
    cuts = range_cuts(rows, ids, "s", tasks)
    cuts = carried(rows, cuts, ids)
    placed = with_range(rows, cuts, ids, "s", "__carry").withColumn("carry", F.get("__carry", F.col(RANGE))).drop("__carry")

    order = Window.partitionBy(*ids, RANGE).orderBy("s", "t")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scanned = (
        placed.withColumn("reach", F.greatest(F.max("t").over(before), "carry"))
        .withColumn("opens", F.expr("reach is null or s > reach + 1").cast("int"))
        .withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    pieces = scanned.groupBy(*ids, RANGE, "island").agg(F.min("s").alias("s"), F.max("t").alias("t"), F.max(F.when(F.col("opens") == 1, F.col("reach"))).alias("reach"))
    # Island 0 of a range continues the one before; the last island of a range may go on in the next.
    pieces = written(pieces, "pieces")

    split = cuts.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(ids)))
    same = F.lit(True)
    for i, c in enumerate(ids):
        same = same & pieces[c].eqNullSafe(split[f"k{i}"])
    whole = pieces.join(F.broadcast(split), same, "left_anti")
    large = pieces.join(F.broadcast(split), same, "left_semi")
    # In large entities only the pieces at range borders need combining: a few per range.
    last = large.groupBy(*ids, RANGE).agg(F.max("island").alias("last"))
    marked = large.join(F.broadcast(last.select(*(F.col(c).alias(f"l{i}") for i, c in enumerate(ids)), F.col(RANGE).alias("lr"), "last")), _null_safe(large, ids) & (F.col(RANGE) == F.col("lr")))
    border = marked.where("island = 0 or island = last")
    inner = marked.where("island > 0 and island < last")
    by_range = Window.partitionBy(*ids).orderBy(RANGE, "island")
    joined = (
        border.withColumn("nth", F.sum((F.col("island") > 0).cast("int")).over(by_range))
        .groupBy(*ids, "nth")
        .agg(F.min("s").alias("s"), F.max("t").alias("t"))
    )
    cols = [F.col(c).alias(n) for c, n in zip(ids, entity)]
    period = [x.select(*cols, F.lit("period").alias("span_kind"), F.col("s").alias("first_pos"), F.col("t").alias("last_pos")) for x in (whole, inner, joined)]
    gap = pieces.where("island > 0 and reach is not null").select(*cols, F.lit("gap").alias("span_kind"), (F.col("reach") + 1).alias("first_pos"), (F.col("s") - 1).alias("last_pos"))
    if max_gap is not None:
        gap = gap.where(F.col("last_pos") - F.col("first_pos") + 1 <= max_gap)
    return period[0].unionByName(period[1]).unionByName(period[2]).unionByName(gap)


def _null_safe(df: DataFrame, ids: Sequence[str]):
    on = F.lit(True)
    for i, c in enumerate(ids):
        on = on & F.col(c).eqNullSafe(F.col(f"l{i}"))
    return on


def carried(rows: DataFrame, cuts: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``cuts`` with ``__carry``: by range, the maximum end of all ranges before it (null for the first)."""
    spark, known = rows.sparkSession, cuts.collect()
    schema = T.StructType([*cuts.schema.fields, T.StructField("__carry", T.ArrayType(T.LongType()))])
    if not known:
        return spark.createDataFrame([], schema)
    right = cuts.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(ids)))
    on = F.lit(True)
    for i, c in enumerate(ids):
        on = on & rows[c].eqNullSafe(right[f"k{i}"])
    large = rows.join(F.broadcast(right), on, "left_semi")
    ends: dict[tuple, dict[int, int]] = {}
    for r in with_range(large, cuts, ids, "s").groupBy(*ids, RANGE).agg(F.max("t").alias("t")).collect():  # one row a range
        ends.setdefault(tuple(r[c] for c in ids), {})[r[RANGE]] = r["t"]
    out = []
    for r in known:
        reach, carry, own = None, [], ends.get(tuple(r[c] for c in ids), {})
        for i in range(len(r["__cuts"]) + 1):
            carry.append(reach)
            reach = max((x for x in (reach, own.get(i)) if x is not None), default=None)
        out.append((*r, carry))
    return spark.createDataFrame(out, schema)
