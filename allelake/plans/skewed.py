"""p2: results per contig and per sample although a few values hold most rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.operators.skew import BIN, balanced_aggregate, fragment, fragment_replicate_join, plan_load
from allelake.session import table

#: A value is reported if it holds at least this share of the rows, in percent.
LEAST_PERCENT = 4


def _keyed(rows: DataFrame, *more: str) -> DataFrame:
    both = F.array(*(F.struct(F.lit(c).alias("key_field"), F.col(c).alias("key_value")) for c in ("contig", "sample")))
    return rows.select("row_id", *more, F.inline(both))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values of contig and sample with at least 4 % of all rows. Null is no value, though its rows count."""
    rows = table(spark, folder, "data_array").select("row_id", "contig", "sample")
    keyed, total = _keyed(rows), rows.count()
    counts = balanced_aggregate(keyed, ["key_field", "key_value"], [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")], salt=["row_id"])
    return counts.where(F.col("key_value").isNotNull() & (F.col("n") * 100 >= LEAST_PERCENT * total)).select("key_field", "key_value")


def p2_bin_loads(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all contigs and samples placed by bin: their number, and whether the fullest of the tasks has at most 1.3 times the mean."""
    keyed = _keyed(table(spark, folder, "data_array").select("row_id", "contig", "sample"))
    plan = plan_load(keyed, ["key_field", "key_value"], salt=["row_id"])
    placed = fragment(keyed, plan, ["row_id"]).repartitionById(plan.tasks, BIN)
    loads = placed.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    return loads.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 1.3 * F.sum("n") / plan.tasks).alias("is_even"))


def p2_key_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Per value of contig and of sample: rows, first and last position, rows called and the sum of lengths."""
    rows = table(spark, folder, "data_array").select("row_id", "contig", "sample", "start_pos", "end_pos", F.coalesce(F.exists("gt", lambda g: g >= 0), F.lit(False)).cast("int").alias("called"))
    keyed = _keyed(rows, "start_pos", "end_pos", "called")
    return balanced_aggregate(
        keyed,
        ["key_field", "key_value"],
        [F.count(F.lit(1)).alias("n"), F.min("start_pos").alias("lo"), F.max("end_pos").alias("hi"), F.sum("called").alias("c"), F.sum((F.col("end_pos") - F.col("start_pos") + 1).cast("long")).alias("span")],
        [F.sum("n").alias("n_rows"), F.min("lo").alias("first_start"), F.max("hi").alias("last_end"), F.sum("c").alias("n_called"), F.sum("span").alias("sum_length")],
        salt=["row_id"],
    )


def p2_contig_by_sample_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each contig with the run counters of their samples: a join on the skewed sample, then per contig."""
    rows = table(spark, folder, "data_array").select("row_id", "contig", "sample")
    depth = table(spark, folder, "sample_stats").groupBy("sample").agg(F.sum("dp_sum").alias("dp_sum"), F.sum("dp_count").alias("dp_count"))
    joined = fragment_replicate_join(rows, depth, ["sample"], plan=plan_load(rows, ["sample"], salt=["row_id"]), salt=["row_id"])
    return balanced_aggregate(
        joined.select("row_id", "contig", "sample", "dp_sum", "dp_count"),
        ["contig"],
        [F.count(F.lit(1)).alias("n"), F.sum(F.expr("dp_sum div dp_count")).alias("d")],
        [F.sum("n").alias("n_rows"), F.sum("d").alias("sum_of_sample_mean_dp")],
        salt=["row_id"],
    )


QUERIES = {"p2_found": p2_found, "p2_bin_loads": p2_bin_loads, "p2_key_profile": p2_key_profile, "p2_contig_by_sample_depth": p2_contig_by_sample_depth}

SQL = {
    "p2_found": f"""
with k as (select 'contig' as key_field, contig as key_value, count(*) as n from data_array group by contig
           union all select 'sample', sample, count(*) from data_array group by sample)
select key_field, key_value from k where key_value is not null and n * 100 >= {LEAST_PERCENT} * (select count(*) from data_array)""",
    "p2_bin_loads": "select 2 * count(*) as n_rows, true as is_even from data_array",
    "p2_key_profile": """
with r as (select *, case when list_max(gt) >= 0 then 1 else 0 end as called from data_array),
     k as (select 'contig' as key_field, contig as key_value, * from r union all select 'sample', sample, * from r)
select key_field, key_value, count(*) as n_rows, min(start_pos) as first_start, max(end_pos) as last_end,
       cast(sum(called) as bigint) as n_called, cast(sum(cast(end_pos as bigint) - start_pos + 1) as bigint) as sum_length
from k group by key_field, key_value""",
    "p2_contig_by_sample_depth": """
with d as (select sample, sum(dp_sum) as dp_sum, sum(dp_count) as dp_count from sample_stats group by sample)
select contig, count(*) as n_rows, cast(sum(dp_sum // nullif(dp_count, 0)) as bigint) as sum_of_sample_mean_dp
from data_array join d using (sample) group by contig""",
}
