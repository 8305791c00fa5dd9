"""p6: percentiles per group and day, and the days that stand out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.llm.percentiles import combine, exact_percentiles, quantiles, sketches
from allelake.session import table, written

PERCENTS = (50, 90)
LEAST_VALUES = 40
GROUP = ["field_name", "grp"]


def _values(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("ingest_ts").cast("date").cast("string").alias("ingest_day")
    qual = table(spark, folder, "data_array").select(F.lit("qual").alias("field_name"), F.col("contig").alias("grp"), day, F.col("qual").cast("double").alias("value"))
    stats = table(spark, folder, "sample_stats").select(
        F.col("centre").alias("grp"), day, F.inline(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).cast("double").alias("value")) for c in ("n_records", "dp_sum"))))
    )
    return qual.unionByName(stats).where("grp is not null and value is not null and not isnan(value)")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days whose percentile is under half or over twice that of the group over all days.

    The bounds of the sketches settle nearly all days; those whose bounds don't
    tell are counted exactly. A row without a day counts for its group only.
    """
    values = _values(spark, folder)
    daily = written(sketches(values, [*GROUP, "ingest_day"], "value"), "daily")
    days = quantiles(daily.where(F.col("n") >= LEAST_VALUES).where("ingest_day is not null"), PERCENTS)
    whole = quantiles(combine(daily, GROUP), PERCENTS).select(*GROUP, "pct", *(F.col(c).alias(f"all_{c}") for c in ("n", "lower", "upper")))
    both = written(days.join(whole, [*GROUP, "pct"]), "both")
    low = lambda d, g: F.col(d) < F.col(g) / 2
    high = lambda d, g: F.col(d) > F.col(g) * 2
    # The comparison is monotone in either value, so it need be judged at the corners only.
    is_low, may_low = low("upper", "all_lower"), low("lower", "all_upper")
    is_high, may_high = high("lower", "all_upper"), high("upper", "all_lower")
    sure = both.where(is_low | is_high)
    open_ = both.where(~(is_low | is_high) & (may_low | may_high))
    # Days and whole groups are counted in one pass.
    whole_day = F.lit("all").alias("ingest_day")
    twice = values.select(*GROUP, "value", F.explode(F.array("ingest_day", F.lit("all"))).alias("ingest_day"))
    wanted = open_.select(*GROUP, "ingest_day", "pct", "n", "lower", "upper").unionByName(
        open_.select(*GROUP, whole_day, "pct", F.col("all_n").alias("n"), F.col("all_lower").alias("lower"), F.col("all_upper").alias("upper")).distinct()
    )
    exact = exact_percentiles(twice, [*GROUP, "ingest_day"], "value", wanted)
    exact_all = exact.where("ingest_day = 'all'").select(*GROUP, "pct", F.col("exact").alias("g"))
    checked = exact.where("ingest_day <> 'all'").select(*GROUP, "ingest_day", "pct", F.col("exact").alias("d")).join(exact_all, [*GROUP, "pct"]).where(low("d", "g") | high("d", "g"))
    out = sure.select(*GROUP, "ingest_day", "pct").unionByName(checked.select(*GROUP, "ingest_day", "pct"))
    return out.withColumn("pct", F.col("pct").cast("int"))


def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles 1 to 99.9 per group over all days, combined from the days, with bounds."""
    daily = sketches(_values(spark, folder), [*GROUP, "ingest_day"], "value")
    return quantiles(combine(daily, GROUP), (1, 10, 50, 90, 99, 99.9))


def p6_outside_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """How many percentiles of the groups there are, and how many lie outside the bounds that the sketches give."""
    values = _values(spark, folder)
    bounds = written(quantiles(combine(sketches(values, [*GROUP, "ingest_day"], "value"), GROUP), (1, 25, 50, 75, 90, 99)), "bounds")
    exact = exact_percentiles(values, GROUP, "value", bounds)
    checked = bounds.join(exact.select(*GROUP, "pct", "exact"), [*GROUP, "pct"])
    return checked.agg(F.count(F.lit(1)).alias("n_percentiles"), F.count_if((F.col("exact") < F.col("lower")) | (F.col("exact") > F.col("upper"))).alias("n_outside"))


QUERIES = {"p6_found": p6_found, "p6_percentiles": p6_percentiles, "p6_outside_bounds": p6_outside_bounds}

_VALUES = """v as (select 'qual' as field_name, contig as grp, cast(qual as double) as value from data_array
           union all select 'n_records', centre, n_records from sample_stats union all select 'dp_sum', centre, dp_sum from sample_stats)"""

SQL = {
    "p6_outside_bounds": f"""
with {_VALUES} select cast(6 * count(*) as bigint) as n_percentiles, cast(0 as bigint) as n_outside
from (select distinct field_name, grp from v where grp is not null and value is not null and not isnan(value))""",
    "p6_found": f"""
with v as (select 'qual' as field_name, contig as grp, strftime(ingest_ts, '%Y-%m-%d') as ingest_day, cast(qual as double) as value from data_array
           union all select 'n_records', centre, strftime(ingest_ts, '%Y-%m-%d'), n_records from sample_stats
           union all select 'dp_sum', centre, strftime(ingest_ts, '%Y-%m-%d'), dp_sum from sample_stats),
     w as (select * from v where grp is not null and value is not null and not isnan(value)),
     d as (select field_name, grp, ingest_day, unnest([50, 90]) as pct, unnest([quantile_disc(value, 0.5), quantile_disc(value, 0.9)]) as q from w
           where ingest_day is not null group by field_name, grp, ingest_day having count(*) >= {LEAST_VALUES}),
     a as (select field_name, grp, unnest([50, 90]) as pct, unnest([quantile_disc(value, 0.5), quantile_disc(value, 0.9)]) as q from w group by field_name, grp)
select d.field_name, d.grp, d.ingest_day, d.pct from d join a using (field_name, grp, pct) where d.q < a.q / 2 or d.q > a.q * 2""",
}
