"""p5: continuous periods and gaps of variant records and reference blocks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.operators.intervals import periods_and_gaps
from allelake.session import table

#: Longer gaps aren't sequenced and are no case.
MAX_GAP = 10_000


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods and gaps per source table, contig and sample."""
    records = table(spark, folder, "data_array").select(F.lit("data_array").alias("src_table"), "contig", "sample", F.col("start_pos").alias("lo"), F.col("end_pos").alias("hi"))
    blocks = table(spark, folder, "ref_blocks").select(F.lit("ref_blocks").alias("src_table"), "contig", "sample", F.col("block_start").alias("lo"), F.col("block_end").alias("hi"))
    return periods_and_gaps(records.unionByName(blocks), ["src_table", "contig", "sample"], "lo", "hi", MAX_GAP)


QUERIES = {"p5_found": p5_found}

SQL = {
    "p5_found": f"""
with v as (select 'data_array' as src_table, contig, sample, cast(start_pos as bigint) as lo, cast(end_pos as bigint) as hi from data_array
           union all select 'ref_blocks', contig, sample, block_start, block_end from ref_blocks),
     b as (select *, max(hi) over (partition by src_table, contig, sample order by lo, hi rows between unbounded preceding and 1 preceding) as reach
           from v where lo is not null and hi >= lo),
     i as (select *, sum(case when reach is null or lo > reach + 1 then 1 else 0 end) over (partition by src_table, contig, sample order by lo, hi rows unbounded preceding) as island from b),
     p as (select src_table, contig, sample, island, min(lo) as first_pos, max(hi) as last_pos from i group by all),
     g as (select src_table, contig, sample, lag(last_pos) over w + 1 as first_pos, first_pos - 1 as last_pos from p window w as (partition by src_table, contig, sample order by island))
select src_table, contig, sample, 'period' as span_kind, first_pos, last_pos from p
union all select src_table, contig, sample, 'gap', first_pos, last_pos from g where first_pos is not null and last_pos - first_pos + 1 <= {MAX_GAP}""",
}
