"""Queries through a dataset on disk: what is ingested, failed, repeated, deleted, exported and read comes out whole.

One dataset is made of ``data_array``: the rows of even files as one batch, those of
odd files, mostly of the same samples, as another, of which a first attempt fails
just before its commit. A record's ``row_id`` travels as the INFO field ``ROW``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.dataset import Dataset, ReadConfig
from allelake.plans.variants import COUNTS, SAMPLES, SITES, V, _af_sql
from allelake.session import scratch_path, table
from allelake.sources.vcf import parse_map

HEADER = '##fileformat=VCFv4.2\n##INFO=<ID=ROW,Number=1,Type=String,Description="Row">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'

#: Regions of the bounded reads, 1-based.
REGIONS = tuple(f"chr{c}:{lo}-{lo + 60_000}" for c in (1, 2, 7) for lo in (1, 200_001, 410_001))
_INSIDE = " or ".join(f"({{t}}.contig = '{r.split(':')[0]}' and {{hi}} >= {int(r.split(':')[1].split('-')[0]) - 1} and {{lo}} <= {int(r.split('-')[1]) - 1})" for r in REGIONS)

_MADE: dict[tuple[str, str], str] = {}


class _Fails(Dataset):
    """A dataset whose batches fail when all is written but the commit."""

    def _commit(self, *args, **kwargs) -> None:
        raise OSError("lost before the commit")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "data_array")
    info = F.map_concat(F.map_filter(parse_map(F.col("info")), lambda k, _: k != "ROW"), F.create_map(F.lit("ROW"), F.col("row_id").cast("string")))
    return rows.select(
        "uri_id", "contig", F.col("start_pos").alias("pos"), "end_pos", "sample", "id", "alleles", "qual", F.col("filter_ids").alias("filters"), "gt", info.alias("info"), parse_map(F.col("fmt")).alias("fmt")
    )


def _made(spark: SparkSession, folder: str) -> str:
    """The dataset of a folder of tables, made once a session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _MADE:
        uri = scratch_path(spark, "store")
        rows = _records(spark, folder)
        headers = rows.select("sample").distinct().withColumn("header", F.lit(HEADER))
        w = Dataset(spark, uri, "w")
        w.create_dataset()
        w.append(rows.where("uri_id % 2 = 0"), headers, "even")
        odd = rows.where("uri_id % 2 <> 0 or uri_id is null")
        try:
            _Fails(spark, uri, "w").append(odd, headers, "odd")
        except OSError:
            pass
        w.append(odd, headers, "odd")
        w.append(odd, headers, "odd")  # committed: nothing happens
        _MADE[key] = uri
    return _MADE[key]


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its name, with the SQL that gives the same."""

    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register



def _row():
    return F.col("info_ROW").cast("long").alias("row_id")


@query("select row_id, sample as sample_name, contig, start_pos + 1 as pos_start, end_pos + 1 as pos_end, id, alleles, filter_ids as filters, gt as fmt_GT from data_array")
def ingest_two_files_one_sample(spark: SparkSession, folder: str) -> DataFrame:
    """All records, though each sample's came in two batches."""
    attrs = ["sample_name", "contig", "pos_start", "pos_end", "id", "alleles", "filters", "fmt_GT"]
    return Dataset(spark, _made(spark, folder)).query(attrs=[*attrs, "info_ROW"]).select(_row(), *attrs)


@query("select contig, count(*) as n_records from data_array group by contig")
def ingest_retry_after_failure(spark: SparkSession, folder: str) -> DataFrame:
    """Records by contig as the log has them, after a failed attempt and one too many."""
    return Dataset(spark, _made(spark, folder)).contig_counts()


@query(f"with {SITES} select contig, pos, alleles, cast(ac as integer) as ac, cast(an as integer) as an from t where an > 0 and ({_INSIDE.format(t='t', lo='t.pos', hi='t.pos')})")
def dataset_variant_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Site statistics of regions from the stored partials of both batches."""
    return Dataset(spark, _made(spark, folder)).query_variant_stats(regions=REGIONS).select("contig", "pos", "alleles", "ac", "an")


@query(f"with {COUNTS} select * from q where {_INSIDE.format(t='q', lo='q.pos', hi='q.pos')}")
def dataset_allele_count(spark: SparkSession, folder: str) -> DataFrame:
    """Allele counts of regions from the stored partials."""
    return Dataset(spark, _made(spark, folder)).query_allele_count(regions=REGIONS)


@query(f"select row_id from ({_af_sql('<=', '0.3')}) semi join (select row_id from data_array d where d.end_pos >= d.start_pos and ({_INSIDE.format(t='d', lo='d.start_pos', hi='d.end_pos')})) using (row_id)")
def dataset_region_af(spark: SparkSession, folder: str) -> DataFrame:
    """Records of regions with a called allele of frequency 0.3 or less; only the regions' counts are read."""
    return Dataset(spark, _made(spark, folder)).query(attrs=["info_ROW"], regions=REGIONS, set_af_filter="<=0.3").select(_row())


@query(f"{_af_sql('>', '0.9')}")
def export_af_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A tab-separated export with a frequency filter, read back."""
    path = scratch_path(spark, "tsv")
    Dataset(spark, _made(spark, folder)).export(output_format="t", tsv_fields=["I:ROW"], output_path=path, set_af_filter=">0.9")
    return spark.read.option("sep", "\t").option("header", True).csv(path).select(F.col("`I:ROW`").cast("long").alias("row_id"))


@query("select 100 as n_exported, 100 as n_counted, 100 as n_read")
def export_limit(spark: SparkSession, folder: str) -> DataFrame:
    """A limit (the feature here) of 100 holds for exports, counts and reads."""
    ds, path = Dataset(spark, _made(spark, folder), cfg=ReadConfig(limit=100)), scratch_path(spark, "tsv")
    ds.export(output_format="t", tsv_fields=["POS"], output_path=path)
    exported = spark.read.option("sep", "\t").option("header", True).csv(path).count()
    return spark.createDataFrame([(exported, ds.count(), ds.query().count())], "n_exported int, n_counted int, n_read int")


@query(f"with {V} select row_id, sample, contig, pos, end_pos, alleles from v where sample <> ''")
def export_read_back(spark: SparkSession, folder: str) -> DataFrame:
    """All samples' text files exported, ingested into another dataset and read; files without a sample column are left out as they have no name of their own."""
    path, uri = scratch_path(spark, "vcf"), scratch_path(spark, "back")
    Dataset(spark, _made(spark, folder)).export(output_dir=path)
    lines = spark.read.text(path)  # the folder gives the sample
    body = lines.where("sample is not null and not startswith(value, '#')").withColumn("c", F.split("value", "\t"))
    c, info = F.col("c"), parse_map(F.col("c")[7])
    alleles = F.concat(F.array(c[3]), F.filter(F.split(c[4], ","), lambda a: a != "."))
    rows = body.select(F.col("sample").cast("string").alias("sample"), c[0].alias("contig"), (c[1].cast("int") - 1).alias("pos"), c[2].alias("id"), alleles.alias("alleles"), info.alias("info"))
    end = F.coalesce(F.element_at("info", "END").try_cast("int") - 1, F.col("pos") + F.length(F.element_at("alleles", 1)) - 1)
    more = {"end_pos": end.cast("int"), "qual": F.lit(None).cast("float"), "filters": F.lit(None).cast("array<string>"), "gt": F.lit(None).cast("array<int>"), "fmt": F.expr("cast(map() as map<string,string>)")}
    w = Dataset(spark, uri, "w")
    w.create_dataset(extra_attrs=["info_ROW"], enable_sample_stats=False)
    rows = rows.withColumns(more)
    w.append(rows, rows.select("sample").distinct().withColumn("header", F.lit(HEADER)))
    return Dataset(spark, uri).query(attrs=["info_ROW", "sample_name", "contig", "pos_start", "pos_end", "alleles"]).select(
        _row(), F.col("sample_name").alias("sample"), "contig", (F.col("pos_start") - 1).alias("pos"), (F.col("pos_end") - 1).alias("end_pos"), "alleles"
    )


@query(f"with {SITES.replace('from data_array', f'from data_array where sample <> {SAMPLES[0]!r}')} select contig, pos, alleles, cast(ac as integer) as ac, cast(an as integer) as an from t where an > 0 and ({_INSIDE.format(t='t', lo='t.pos', hi='t.pos')})")
def dataset_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Site statistics after a sample was deleted and the batches were folded into one."""
    uri = scratch_path(spark, "store")
    rows = _records(spark, folder)
    w = Dataset(spark, uri, "w")
    w.create_dataset(enable_sample_stats=False, enable_allele_count=False)
    w.append(rows, rows.select("sample").distinct().withColumn("header", F.lit(HEADER)))
    w.delete_samples([SAMPLES[0]])
    w.compact()
    w.vacuum()
    return Dataset(spark, uri).query_variant_stats(regions=REGIONS).select("contig", "pos", "alleles", "ac", "an")
