"""The interval-overlap join of records with regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelake.operators.ranges import RANGE, range_cuts, with_range
from allelake.session import written

#: Region tables of at most this many rows, and this many a contig, are broadcast and joined by contig and range; others go through bins.
SMALL, CROWDED = 10_000, 200

#: Width of a bin, and the longest record, in bins, that is copied to all its bins.
BIN, WIDE = 1_000, 64


def few_bounds(regions: DataFrame, small: int = SMALL) -> list | None:
    """Rows ``contig, lo, hi, n``: the regions' bounds by contig, for a scan predicate; None where there are too many regions or contigs for that."""
    bounds = regions.where("hi >= lo").groupBy("contig").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n")).limit(CROWDED + 1).collect()
    return bounds if len(bounds) <= CROWDED and sum(b["n"] for b in bounds) <= small else None


def overlap_join(records: DataFrame, regions: DataFrame, small: int = SMALL, bounds: list | None = None, end: str = "end_pos") -> DataFrame:
    """One row per pair of a record and a region with a common position.

    ``records`` needs ``contig, pos`` and ``end``, ``regions`` ``contig, lo, hi, line`` (all
    0-based, inclusive); the result has the records' columns and ``region_lo,
    region_hi, region_line``. Regions aren't coalesced: a record is there once for
    each it overlaps. Nulls, and ends before starts, overlap nothing.

    The bounds of few regions become a scan predicate. Few a contig are broadcast
    and compared one by one, more go through :func:`overlap_join_binned`.
    ``bounds``: what :func:`few_bounds` gave, where the caller has it.
    """
    bounds = few_bounds(regions, small) if bounds is None else bounds
    if bounds is None:
        return overlap_join_binned(records, regions, end=end)
    near = F.lit(False)  # reaches the scan: contig and position ranges prune files and row groups
    for b in bounds:
        near = near | ((F.col("contig") == b["contig"]) & (F.col("pos") <= b["hi"]) & (F.col(end) >= b["lo"]))
    records = records.where(near)
    if any(b["n"] > CROWDED for b in bounds):
        return overlap_join_binned(records, regions, end=end)
    r = _named(regions)
    return records.join(F.broadcast(r), (records["contig"] == r["__contig"]) & _meet(end)).drop("__contig")  # at most SMALL rows


def _named(regions: DataFrame) -> DataFrame:
    return regions.where("hi >= lo").select(F.col("contig").alias("__contig"), F.col("lo").alias("region_lo"), F.col("hi").alias("region_hi"), F.col("line").alias("region_line"))


def _meet(end: str) -> Column:
    return (F.col("pos") <= F.col("region_hi")) & (F.col(end) >= F.col("region_lo")) & (F.col(end) >= F.col("pos"))


def overlap_join_binned(records: DataFrame, regions: DataFrame, width: int = BIN, end: str = "end_pos") -> DataFrame:
    """:func:`overlap_join` as an equi-join on (contig, bin), for region tables of any size.

    Intervals are copied to the bins they touch; a pair counts in the first bin
    both touch, so it comes once. Longer intervals have levels of ``WIDE`` times
    wider bins, so a contig-long one makes no million copies. A pair meets on
    the level of its longer interval: there that interval stands itself, and
    copies of the shorter ones of the other side, if that level is in use at all.
    """
    long_ = T.LongType()

    def level(lo: str, hi: str) -> Column:
        size = F.col(hi).cast(long_) - F.col(lo) + 1
        return F.when(size <= width * WIDE, 0).when(size <= width * WIDE**2, 1).when(size <= width * WIDE**3, 2).otherwise(3)

    def step(lev: Column) -> Column:
        return F.element_at(F.array(*(F.lit(width * WIDE**i).cast(long_) for i in range(4))), lev + 1)

    def binned(df: DataFrame, lo: str, hi: str, lev: str, bin_: str) -> DataFrame:
        return df.withColumn(bin_, F.explode(F.sequence(F.floor(F.col(lo) / step(F.col(lev))), F.floor(F.col(hi) / step(F.col(lev))))))

    def copied(df: DataFrame, own: str, to: list[int], above: bool, lev: str) -> DataFrame:
        return df.withColumn(lev, F.explode(F.filter(F.array(*(F.lit(i) for i in to)), lambda i: (i > F.col(own)) if above else (i >= F.col(own)))))

    r = _named(regions).withColumn("__rl", level("region_lo", "region_hi"))
    v = records.where(F.col(end) >= F.col("pos")).withColumn("__vl", level("pos", end))
    at = {name: sorted(x[0] for x in df.select(own).distinct().collect()) for name, df, own in (("v", v, "__vl"), ("r", r, "__rl"))}  # four levels at most
    first = F.col("__bin") == F.floor(F.greatest("pos", "region_lo") / step(F.col("__level")))
    out = None
    for left, right in (
        (v.withColumn("__level", F.col("__vl")), copied(r, "__rl", at["v"], False, "__rlevel")),
        (copied(v, "__vl", at["r"], True, "__level"), r.withColumn("__rlevel", F.col("__rl"))),
    ):
        if out is not None and max(at["r"], default=0) <= min(at["v"], default=0):
            break  # no region is on a higher level than any record
        left, right = binned(left, "pos", end, "__level", "__bin"), binned(right, "region_lo", "region_hi", "__rlevel", "__rbin")
        on = (left["contig"] == right["__contig"]) & (F.col("__level") == F.col("__rlevel")) & (F.col("__bin") == F.col("__rbin"))
        part = left.join(right, on & _meet(end) & first).drop("__contig", "__vl", "__rl", "__level", "__bin", "__rlevel", "__rbin")
        out = part if out is None else out.unionByName(part)
    return out


def stab_sums(points: DataFrame, blocks: DataFrame, values: list[str]) -> DataFrame:
    """For each point ``contig, pos`` the sums of ``values`` over the blocks ``contig, lo, hi`` that cover it.

    Points count once each; points without a block, nulls, and blocks whose end is
    before their start are left out; a null value counts as 0, but a sum without
    any value is null.

    A sweep: a block adds its values where it starts and takes them back behind
    its end; the running sum along a contig is each point's. Contigs too large for
    a task are cut into ranges and what lies before a range is carried into it, so
    neither many blocks over one point nor a contig-long block make pairs.
    """
    sums = [c for v in values for c in (f"__s_{v}", f"__n_{v}")]
    on = lambda sign: [x for v in values for x in ((F.coalesce(F.col(v), F.lit(0)) * sign).cast("long").alias(f"__s_{v}"), (F.col(v).isNotNull().cast("long") * sign).alias(f"__n_{v}"))]
    whole = blocks.where("contig is not null and hi >= lo")
    steps = [whole.select("contig", at.cast("long").alias("pos"), F.lit(sign).cast("long").alias("__open"), F.lit(0).alias("__point"), *on(sign)) for at, sign in ((F.col("lo"), 1), (F.col("hi") + F.lit(1).cast("long"), -1))]
    spots = points.where("contig is not null and pos is not null").select("contig", F.col("pos").cast("long").alias("pos"), F.lit(0).cast("long").alias("__open"), F.lit(1).alias("__point"), *(F.lit(0).cast("long").alias(c) for c in sums))
    running = ["__open", *sums]
    # One row a place, combined before the shuffle.
    places = steps[0].unionByName(steps[1]).unionByName(spots).groupBy("contig", "pos").agg(*(F.sum(c).alias(c) for c in running), F.max("__point").alias("__point"))
    places = written(places, "places")
    cuts = range_cuts(places, ["contig"], "pos")
    placed = with_range(places, cuts, ["contig"], "pos")
    upto = Window.partitionBy("contig", RANGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.withColumns({c: F.sum(c).over(upto) for c in running})
    totals = placed.groupBy("contig", RANGE).agg(*(F.sum(c).alias(c) for c in running))
    before = Window.partitionBy("contig").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col("contig").alias("__c"), F.col(RANGE).alias("__r"), *(F.sum(c).over(before).alias(f"{c}__before") for c in running)).where("__r > 0")
    found = own.where("__point = 1").join(F.broadcast(carry), (F.col("contig") == F.col("__c")) & (F.col(RANGE) == F.col("__r")), "left")  # ranges but the first: at most 2 * tasks
    at = lambda c: F.col(c) + F.coalesce(F.col(f"{c}__before"), F.lit(0))
    kind = points.schema["pos"].dataType
    return found.where(at("__open") > 0).select("contig", F.col("pos").cast(kind).alias("pos"), *(F.when(at(f"__n_{v}") > 0, at(f"__s_{v}")).alias(v) for v in values))
