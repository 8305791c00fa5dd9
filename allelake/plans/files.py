"""p1: many small deliveries into few files that hold every record once."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.operators.consolidate import consolidate, consolidated, listed_files
from allelake.operators.redelivery import once, redelivered
from allelake.session import scratch_path, table

#: What makes two rows the same record.
RECORD = ("contig", "start_pos", "end_pos", "sample", "alleles")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Listings that repeat one another, found in the consolidated files."""
    rows = consolidated(spark, f"{folder}/data_array.parquet")
    return redelivered(table(spark, folder, "sample_uris"), rows, "uri_id", "uri", RECORD)


def p1_once(spark: SparkSession, folder: str) -> DataFrame:
    """Every record once: consolidated files, repeats dropped, written as well-sized files and read again."""
    kept = once(consolidated(spark, f"{folder}/data_array.parquet"), RECORD, "row_id")
    into = scratch_path(spark, "once")
    kept.write.option("compression", "zstd").parquet(into)
    return consolidated(spark, into).select("row_id", "uri_id", "contig", "start_pos", "end_pos", "sample")


def p1_consolidate(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of a consolidation of all small tables' files: rows in, rows out, blocks in, blocks out."""
    reports = []
    for name in ("data_array", "sample_uris", "ref_blocks", "sample_stats", "attr_cells"):
        report = consolidate(listed_files(spark, f"{folder}/{name}.parquet"), scratch_path(spark, name))
        reports.append(report.agg(F.lit(name).alias("table_name"), F.sum("rows").alias("n_rows"), (F.sum("rows") - F.sum("input_rows")).alias("rows_lost"), (F.sum("blocks") - F.sum("input_blocks")).alias("blocks_lost")))
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def p1_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    """A table of many tiny files in folders by contig, consolidated: all rows and the folders' column."""
    path = scratch_path(spark, "tiny")
    rows = table(spark, folder, "data_array").where("contig <> ''").select("row_id", "contig", "start_pos", "sample")
    rows.repartition(16, "row_id").write.partitionBy("contig").parquet(path)
    return consolidated(spark, path).select("row_id", "contig", "start_pos", "sample")


QUERIES = {"p1_found": p1_found, "p1_once": p1_once, "p1_consolidate": p1_consolidate, "p1_partitioned": p1_partitioned}

SQL = {
    "p1_found": """
with r as (select distinct uri_id, contig, start_pos, end_pos, sample, alleles from data_array),
     n as (select uri_id, count(*) as n from r group by uri_id),
     c as (select a.uri_id as a, b.uri_id as b from r a join r b on a.uri_id <> b.uri_id and a.contig is not distinct from b.contig and a.start_pos is not distinct from b.start_pos
            and a.end_pos is not distinct from b.end_pos and a.sample is not distinct from b.sample and a.alleles is not distinct from b.alleles
           join n on n.uri_id = a.uri_id group by a.uri_id, b.uri_id, n.n having count(*) = n.n)
select least(a, b) as uri_id_1, greatest(a, b) as uri_id_2 from c where a in (select uri_id from sample_uris) and b in (select uri_id from sample_uris)
union
select a.uri_id, b.uri_id from sample_uris a join sample_uris b on a.uri = b.uri and a.uri_id < b.uri_id""",
    "p1_partitioned": "select row_id, contig, start_pos, sample from data_array where contig <> ''",
    "p1_once": """
select row_id, uri_id, contig, start_pos, end_pos, sample from data_array
where row_id in (select min(row_id) from data_array group by contig, start_pos, end_pos, sample, alleles)""",
    "p1_consolidate": "".join(
        f"{'union all ' * (i > 0)}select '{t}' as table_name, count(*) as n_rows, cast(0 as bigint) as rows_lost, cast(0 as bigint) as blocks_lost from {t} "
        for i, t in enumerate(("data_array", "sample_uris", "ref_blocks", "sample_stats", "attr_cells"))
    ),
}
