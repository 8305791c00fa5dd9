"""Queries for the operators of variant stores, over ``data_array`` and its companions.

Records come from ``data_array``, small region lists from ``supplier`` (by a rule,
half overlapping), large ones from ``ref_blocks``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelake.functions import alleles as A
from allelake.operators import association, frequency, select, stats
from allelake.operators.cohort import merge_cohort
from allelake.operators.overlap import overlap_join, overlap_join_binned, stab_sums
from allelake.regions import coalesced_table
from allelake.session import scratch_path, table, written
from allelake.sinks.text import tsv_columns
from allelake.sources.vcf import Field, parse_map
from allelake.streaming.ingest import windowed_records

#: A sample that holds many records, used by the queries on single samples.
SAMPLES = ("NXCTRL01", "QC-mix.b", "ZR0450")


def _number(key: str):
    """The whole number a key of ``fmt`` has; null if it has none. Found by position, which is much faster than by pattern."""
    text = F.concat(F.lit(";"), F.col("fmt"), F.lit(";"))
    at = F.instr(text, f";{key}=")
    value = F.substring_index(F.substring(text, at + len(key) + 2, F.lit(12)), ";", 1)
    return F.when((at > 0) & value.rlike("^[0-9]{1,9}$"), value).try_cast("int")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """``data_array`` as records."""
    return table(spark, folder, "data_array").select(
        "row_id", "contig", F.col("start_pos").alias("pos"), "end_pos", "sample", "id", "alleles", "qual", F.col("filter_ids").alias("filters"), "gt", "info", "fmt",
        _number("DP").alias("dp"), _number("GQ").alias("gq"), "ingest_ts",
    )


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """A region list made from ``supplier``."""
    return table(spark, folder, "supplier").select(
        F.expr("concat('chr', s_suppkey % 22 + 1)").alias("contig"), F.expr("cast((s_suppkey * 4801) % 500000 as int)").alias("lo"),
        F.expr("cast((s_suppkey * 4801) % 500000 + 400 + (s_suppkey % 2) * 5000 as int)").alias("hi"), F.expr("cast(s_suppkey as int)").alias("line"),
    )


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """``ref_blocks`` as regions."""
    return table(spark, folder, "ref_blocks").select("contig", F.col("block_start").alias("lo"), F.col("block_end").alias("hi"), F.col("block_id").alias("line"))


def _fits_int(df: DataFrame, column: str) -> bool:
    return df.where(~F.col(column).between(-(2**31), 2**31 - 1)).isEmpty()  # row groups' bounds answer it


V = """v as (select row_id, contig, start_pos as pos, end_pos, sample, id, alleles, qual, filter_ids as filters, gt, info, fmt, ingest_ts,
  try_cast(regexp_extract(fmt, '(^|;)DP=([0-9]{1,9})(;|$)', 2) as integer) as dp, try_cast(regexp_extract(fmt, '(^|;)GQ=([0-9]{1,9})(;|$)', 2) as integer) as gq from data_array)"""
R = """r as (select 'chr' || cast(s_suppkey % 22 + 1 as varchar) as contig, cast((s_suppkey * 4801) % 500000 as integer) as lo,
  cast((s_suppkey * 4801) % 500000 + 400 + (s_suppkey % 2) * 5000 as integer) as hi, cast(s_suppkey as integer) as line from supplier)"""
MEET = "v.contig = r.contig and v.pos <= r.hi and v.end_pos >= r.lo and v.end_pos >= v.pos"
GOOD = "g as (select * from v where list_max(gt) >= 0 and list_max(gt) < len(alleles))"
CALLS = f"{V}, {GOOD}, c as (select row_id, contig, pos, sample, gt, alleles, unnest(gt) as a from g), k as (select *, case when a = 0 then 'ref' else alleles[1] || ',' || alleles[a + 1] end as allele from c where a >= 0)"
SITES = f"{CALLS}, z as (select contig, pos, allele, 1 as n from k union all select contig, pos, 'ref', 0 from g), s as (select contig, pos, allele as alleles, sum(n) as ac from z group by all), t as (select *, sum(ac) over (partition by contig, pos) as an from s)"
BASE = "^[ACGTacgt]$"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"with {V}, {R} select v.row_id, r.line as region_line, r.lo as region_lo, r.hi as region_hi from v join r on {MEET}")
def region_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Records and the regions they overlap, one row per pair."""
    return overlap_join(records(spark, folder), regions(spark, folder)).select("row_id", "region_line", "region_lo", "region_hi")


@query(f"""with {V}, r as (select contig, block_start as lo, block_end as hi, block_id as line from ref_blocks where block_end >= block_start)
select cast(r.line as integer) as region_line, count(*) as n_records, min(v.pos) as first_pos, max(v.end_pos) as last_pos from v join r on {MEET} group by r.line""")
def region_overlap_binned(spark: SparkSession, folder: str) -> DataFrame:
    """Per reference block the records of all samples that overlap it, by bins. ``region_line`` is an int as in SQL; a bigint where a block found has an id that no int holds, where SQL fails."""
    r = blocks(spark, folder)
    found = overlap_join_binned(records(spark, folder), r).groupBy("region_line").agg(F.count(F.lit(1)).alias("n_records"), F.min("pos").alias("first_pos"), F.max("end_pos").alias("last_pos"))
    if not _fits_int(r, "line"):
        found = written(found, "overlaps")  # such ids count only where a record overlaps their block
        if not _fits_int(found, "region_line"):
            return found
    return found.withColumn("region_line", F.col("region_line").cast("int"))


@query(f"with {V}, {R} select count(*) as n_pairs, count(distinct v.row_id) as n_records from v join r on {MEET}")
def region_count(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs, and how many records in any region."""
    pairs = overlap_join(records(spark, folder).select("row_id", "contig", "pos", "end_pos"), regions(spark, folder))
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("row_id").alias("n_records"))


@query("""with b as (select contig, lo, hi, max(hi) over (partition by contig order by lo, hi rows between unbounded preceding and 1 preceding) as reach
  from (select contig, block_start as lo, block_end as hi from ref_blocks where block_end >= block_start)),
i as (select *, sum(case when reach is null or lo > reach + 1 then 1 else 0 end) over (partition by contig order by lo, hi rows unbounded preceding) as n from b)
select contig, min(lo) as lo, max(hi) as hi from i group by contig, n""")
def region_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    """Reference blocks of all samples joined where they overlap or adjoin."""
    return coalesced_table(blocks(spark, folder)).select("contig", "lo", "hi")


@query(f"with {V}, {R} select v.row_id, v.sample as sample_name, v.pos + 1 as pos_start, v.end_pos + 1 as pos_end, r.lo as query_bed_start, r.hi + 1 as query_bed_end, r.line as query_bed_line from v join r on {MEET}")
def query_bed_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Result columns of a read with regions."""
    j = overlap_join(records(spark, folder), regions(spark, folder))
    return j.select("row_id", F.col("sample").alias("sample_name"), (F.col("pos") + 1).alias("pos_start"), (F.col("end_pos") + 1).alias("pos_end"), F.col("region_lo").alias("query_bed_start"), (F.col("region_hi") + 1).alias("query_bed_end"), F.col("region_line").alias("query_bed_line"))


@query(f"with {V} select row_id, sample, contig, pos from v where sample in {SAMPLES}")
def sample_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Records of some samples."""
    return select.with_samples(records(spark, folder), SAMPLES).select("row_id", "sample", "contig", "pos")


@query("select distinct sample from sample_uris where sample is not null and sample not in (select sample from data_array where sample is not null)")
def sample_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Samples as listed that no record has."""
    return table(spark, folder, "sample_uris").where("sample is not null").select("sample").distinct().join(table(spark, folder, "data_array"), "sample", "left_anti")


@query("select row_id, start_pos + 1 as pos_start, end_pos + 1 as pos_end from data_array")
def pos_one_based(spark: SparkSession, folder: str) -> DataFrame:
    """1-based positions."""
    return records(spark, folder).select("row_id", (F.col("pos") + 1).alias("pos_start"), (F.col("end_pos") + 1).alias("pos_end"))


@query("""select row_id, coalesce(try_cast(regexp_extract(info, '(^|;)END=([0-9]{1,9})(;|$)', 2) as integer) - 1, cast(start_pos + length(alleles[1]) - 1 as integer)) as derived_end from data_array""")
def end_pos_derive(spark: SparkSession, folder: str) -> DataFrame:
    """End positions from END or the reference allele."""
    end = F.regexp_extract("info", "(^|;)END=([0-9]{1,9})(;|$)", 2)
    return records(spark, folder).select("row_id", A.end_position(F.col("pos"), F.element_at("alleles", 1), end).alias("derived_end"))


@query("""select row_id, case when info is null then null else list_sort(list_distinct(list_filter(list_transform(string_split(info, ';'), lambda p: split_part(p, '=', 1)), lambda k: k not in ('', '.')))) end as info_keys from data_array where info is not null""")
def info_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The INFO keys of each record."""
    rows = records(spark, folder).where("info is not null")
    return rows.select("row_id", F.array_sort(F.map_keys(parse_map(F.col("info")))).alias("info_keys"))


@query(f"with {SITES} select contig, pos, alleles, cast(ac as integer) as ac, cast(an as integer) as an, round(cast(ac as double) / an, 6) as af from t where an > 0")
def variant_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Allele counts and frequencies per site."""
    return _rounded(stats.variant_stats(stats.variant_stats_partial(records(spark, folder))))


def _rounded(s: DataFrame) -> DataFrame:
    return s.withColumn("af", F.round(F.col("ac").cast("double") / F.col("an"), 6))


@query(f"with {SITES} select contig, pos, alleles, cast(ac as integer) as ac, cast(an as integer) as an, round(cast(ac as double) / an, 6) as af from t where an > 0 and alleles <> 'ref'")
def variant_stats_drop_ref(spark: SparkSession, folder: str) -> DataFrame:
    """The same without reference rows."""
    return _rounded(stats.variant_stats(stats.variant_stats_partial(records(spark, folder)), drop_ref=True))


@query(f"""with {SITES}, n as (select 2 * count(distinct sample) as an2 from data_array)
select contig, pos, alleles, cast(ac as integer) as ac, cast(an2 as integer) as an, round(cast(ac as double) / an2, 6) as af from t, n where an > 0""")
def variant_stats_scan_all(spark: SparkSession, folder: str) -> DataFrame:
    """Frequencies over all samples, called or not."""
    r = records(spark, folder)
    n = r.agg(F.countDistinct("sample")).first()[0]
    return _rounded(stats.variant_stats(stats.variant_stats_partial(r), samples=n))


@query(f"""with {SITES}, {R} select contig, pos, alleles, cast(ac as integer) as ac, cast(an as integer) as an from t
where an > 0 and exists (select 1 from r where r.contig = t.contig and t.pos between r.lo and r.hi)""")
def variant_stats_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the sites in the regions."""
    r = regions(spark, folder).select(F.col("contig").alias("rc"), "lo", "hi")
    v = records(spark, folder)
    inside = v.join(F.broadcast(r), (v["contig"] == r["rc"]) & v["pos"].between(r["lo"], r["hi"]), "left_semi")  # supplier: a fixed list of regions
    return stats.variant_stats(stats.variant_stats_partial(inside)).select("contig", "pos", "alleles", "ac", "an")


@query(f"""with {V}, {GOOD}, n as (select *, len(alleles) = 2 and alleles[2] = '<NON_REF>' and gt[1] = 0 as block from g), c as (select *, unnest(gt) as a from n),
k as (select contig, pos, end_pos, sample, len(gt) as an, case when a = 0 and block then 'nr' when a = 0 then 'ref'
  when length(alleles[1]) > 1 and length(alleles[a + 1]) > 1 and right(alleles[1], 1) = right(alleles[a + 1], 1) and not starts_with(alleles[a + 1], '<') then alleles[1][:-2] || ',' || alleles[a + 1][:-2]
  else alleles[1] || ',' || alleles[a + 1] end as allele from c where a >= 0)
select contig, pos, end_pos, sample, allele, cast(count(*) as integer) as ac, cast(max(an) as integer) as an from k group by contig, pos, end_pos, sample, allele""")
def variant_stats_v3_partial(spark: SparkSession, folder: str) -> DataFrame:
    """Partials with trimmed alleles and reference blocks apart."""
    return stats.variant_stats_partial(records(spark, folder), 3).drop("n_hom")


FORM = """case when len(gt) = 1 then case when gt[1] > 0 then '1' end when len(gt) = 2 then case
  when least(gt[1], gt[2]) < 0 and greatest(gt[1], gt[2]) > 0 then '.,1' when least(gt[1], gt[2]) = 0 and greatest(gt[1], gt[2]) > 0 then '0,1'
  when gt[1] > 0 and gt[1] = gt[2] then '1,1' when gt[1] > 0 and gt[2] > 0 then '1,2' end end"""
COUNTS = f"""{V}, c as (select contig, pos, alleles[1] as ref, array_to_string(list_sort(list_distinct(list_transform(list_filter(gt, lambda x: x > 0), lambda x: alleles[x + 1]))), ',') as alt,
  case when len(filters) > 0 then array_to_string(filters, ';') else '.' end as filter, {FORM} as gt from v where len(gt) between 1 and 2 and list_max(gt) < len(alleles)),
q as (select contig, pos, ref, alt, filter, gt, cast(count(*) as integer) as count from c where gt is not null group by all)"""


@query(f"with {COUNTS} select * from q")
def allele_count(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by site, alleles, filter and genotype."""
    return stats.sum_allele_counts(stats.allele_count(records(spark, folder)))


@query(f"with {COUNTS}, {R} select * from q where exists (select 1 from r where r.contig = q.contig and q.pos between r.lo and r.hi)")
def allele_count_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Allele counts of the sites in the regions."""
    r = regions(spark, folder).select(F.col("contig").alias("rc"), "lo", "hi")
    q = stats.allele_count(records(spark, folder))
    return q.join(F.broadcast(r), (q["contig"] == r["rc"]) & q["pos"].between(r["lo"], r["hi"]), "left_semi")  # supplier: a fixed list of regions


ALT = "alleles[a + 1]"
SNP = f"(regexp_matches(alleles[1], '{BASE}') and regexp_matches({ALT}, '{BASE}') and upper(alleles[1]) <> upper({ALT}))"
TI = f"upper(alleles[1]) || upper({ALT}) in ('AG', 'GA', 'CT', 'TC')"
PLAINALT = f"(not starts_with({ALT}, '<') and {ALT} <> '*')"
QC = f"""{V}, u as (select *, coalesce(list_max(gt), -1) >= 0 as called, coalesce(list_max(gt), -1) < len(alleles) as valid from v),
a1 as (select row_id, alleles, unnest(gt) as a from u where called and valid),
a2 as (select row_id, sum(case when {SNP} then 1 else 0 end) as snp, sum(case when {SNP} and {TI} then 1 else 0 end) as ti, sum(case when {SNP} and not {TI} then 1 else 0 end) as tv,
  sum(case when {PLAINALT} and length({ALT}) > length(alleles[1]) then 1 else 0 end) as ins, sum(case when {PLAINALT} and length({ALT}) < length(alleles[1]) then 1 else 0 end) as del,
  sum(case when {ALT} = '*' then 1 else 0 end) as star from a1 where a > 0 group by row_id),
a3 as (select row_id, count(*) as single from (select row_id, a from a1 where a > 0 group by row_id, a having count(*) = 1) group by row_id),
w as (select sample, dp, gq, called, valid, gt, alleles, coalesce(snp, 0) as snp, coalesce(ti, 0) as ti, coalesce(tv, 0) as tv, coalesce(ins, 0) as ins, coalesce(del, 0) as del, coalesce(star, 0) as star, coalesce(single, 0) as single
  from u left join a2 using (row_id) left join a3 using (row_id)),
p as (select sample, sum(dp) as dp_sum, sum(cast(dp as bigint) * dp) as dp_sum2, count(dp) as dp_count, min(dp) as dp_min, max(dp) as dp_max,
  sum(gq) as gq_sum, sum(cast(gq as bigint) * gq) as gq_sum2, count(gq) as gq_count, min(gq) as gq_min, max(gq) as gq_max, count(*) as n_records,
  count(*) filter (called and valid) as n_called, count(*) filter (not called) as n_not_called, count(*) filter (called and valid and list_max(gt) = 0 and list_min(gt) = 0) as n_hom_ref,
  count(*) filter (called and valid and list_min(gt) >= 0 and list_min(gt) <> list_max(gt)) as n_het, sum(single) as n_singleton, sum(snp) as n_snp, sum(ti) as n_transition, sum(tv) as n_transversion,
  sum(ins) as n_insertion, sum(del) as n_deletion, sum(star) as n_star, count(*) filter (len(alleles) > 2) as n_multiallelic from w group by sample)"""


@query(f"with {QC} select sample, {', '.join(f'cast({c} as bigint) as {c}' for c in stats.COUNTERS)} from p")
def sample_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The 23 counters of each sample."""
    return stats.sample_stats(records(spark, folder)).select("sample", *stats.COUNTERS)


def _sd(c: str) -> str:
    return f"case when {c}_count > 1 then round(cast(cast(sqrt(greatest(cast({c}_sum2 as double) / {c}_count - power(cast({c}_sum as double) / {c}_count, 2), 0)) as float) as double), 2) end as {c}_stddev"


@query(f"""with {QC}, h as (select *, n_called - n_hom_ref - n_het as n_hom_var, n_called - n_hom_ref as n_non_ref from p)
select sample, case when dp_count > 0 then round(cast(cast(cast(dp_sum as double) / dp_count as float) as double), 2) end as dp_mean, {_sd('dp')}, cast(coalesce(dp_min, 0) as bigint) as dp_min, cast(coalesce(dp_max, 0) as bigint) as dp_max,
 case when gq_count > 0 then round(cast(cast(cast(gq_sum as double) / gq_count as float) as double), 2) end as gq_mean, {_sd('gq')}, cast(coalesce(gq_min, 0) as bigint) as gq_min, cast(coalesce(gq_max, 0) as bigint) as gq_max,
 round(cast(cast(n_called / nullif(cast(n_called + n_not_called as double), 0) as float) as double), 4) as call_rate, n_called, n_not_called, n_hom_ref, n_het, n_hom_var, n_non_ref,
 round(cast(cast(n_transition / nullif(cast(n_transversion as double), 0) as float) as double), 4) as r_ti_tv, round(cast(cast(n_het / nullif(cast(n_hom_var as double), 0) as float) as double), 4) as r_het_hom_var, round(cast(cast(n_insertion / nullif(cast(n_deletion as double), 0) as float) as double), 4) as r_insertion_deletion,
 n_records, n_multiallelic from h""")
def sample_qc(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of each sample from its counters."""
    q = stats.sample_qc(stats.sample_stats(records(spark, folder)))
    digits = {c: 2 for c in ("dp_mean", "dp_stddev", "gq_mean", "gq_stddev")} | {c: 4 for c in ("call_rate", "r_ti_tv", "r_het_hom_var", "r_insertion_deletion")}
    return q.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()}).drop("n_singleton", "n_snp", "n_insertion", "n_deletion", "n_transition", "n_transversion", "n_star")


@query("""select sample, cast(sum(dp_sum) as bigint) as dp_sum, max(dp_max) as dp_max, min(gq_min) as gq_min, cast(sum(n_records) as bigint) as n_records, cast(sum(n_called) as bigint) as n_called from sample_stats group by sample""")
def sample_stats_combine(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of all runs combined per sample."""
    return stats.sum_sample_stats(table(spark, folder, "sample_stats")).select("sample", "dp_sum", "dp_max", "gq_min", "n_records", "n_called")


def _af_sql(op: str, x: str) -> str:
    return f"""with {SITES}, y as (select row_id, contig, pos, alleles, gt, unnest(gt) as a from v where gt is not null),
j as (select y.row_id, y.a, case when t.an is null then false when y.alleles[y.a + 1] = '<NON_REF>' then false
  else cast(cast(coalesce(t.ac, 0) as double) / t.an as float) {op} cast({x} as float) end as ok
 from y left join (select contig, pos, alleles as akey, ac, an from t) t on t.contig = y.contig and t.pos = y.pos and t.akey = case when y.a = 0 then 'ref' else y.alleles[1] || ',' || y.alleles[y.a + 1] end where y.a >= 0)
select row_id from j group by row_id having bool_or(ok) union select row_id from v where list_max(gt) < 0"""


def _af(spark: SparkSession, folder: str, condition: str) -> DataFrame:
    r = records(spark, folder)
    return frequency.af_filter(r, stats.variant_stats_partial(r), condition).select("row_id")


@query(_af_sql("<", "0.2"))
def af_filter_lt(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a called allele rarer than 0.2."""
    return _af(spark, folder, "<0.2")


@query(_af_sql(">=", "0.5"))
def af_filter_ge(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a called allele of frequency 0.5 or more."""
    return _af(spark, folder, ">=0.5")


@query(_af_sql("<>", "1"))
def af_filter_ne(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a called allele that isn't fixed."""
    return _af(spark, folder, "!=1")


@query(f"""with {SITES}, y as (select row_id, contig, pos, alleles, unnest(alleles) as al, generate_subscripts(alleles, 1) as i from v),
j as (select y.row_id, y.i, case when y.al = '<NON_REF>' then 0 else coalesce(t.ac, 0) end as ac, n.an from y
 join (select distinct contig, pos, an from t) n on n.contig = y.contig and n.pos = y.pos
 left join t on t.contig = y.contig and t.pos = y.pos and t.alleles = case when y.i = 1 then 'ref' else y.alleles[1] || ',' || y.al end)
select row_id, list(cast(ac as integer) order by i) as iac, cast(any_value(an) as integer) as ian from j group by row_id""")
def iaf_annotation(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of each of a record's alleles at its site."""
    r = records(spark, folder)
    return frequency.annotate(r, stats.variant_stats_partial(r)).where("ian is not null").select("row_id", "iac", "ian")


@query("""select d.contig, d.pos, cast(sum(b.an) as bigint) as an, cast(sum(b.ac) as bigint) as ac from (select distinct contig, start_pos as pos from data_array) d
join ref_blocks b on b.contig = d.contig and d.pos between b.block_start and b.block_end group by d.contig, d.pos""")
def refblock_stab(spark: SparkSession, folder: str) -> DataFrame:
    """At each record's site the sums over the reference blocks that cover it."""
    b = table(spark, folder, "ref_blocks").select("contig", F.col("block_start").alias("lo"), F.col("block_end").alias("hi"), "an", "ac")
    return stab_sums(records(spark, folder), b, ["an", "ac"])


@query(f"with {V}, o as (select *, row_number() over (partition by contig, pos, sample order by row_id) as nth from v) select contig, pos, cast(nth as integer) as nth, count(*) as n_samples, cast(sum(row_id) as bigint) as row_ids from o group by contig, pos, nth")
def record_merge_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    """The groups that merge into cohort records: the k-th records of the samples at a position."""
    w = Window.partitionBy("contig", "pos", "sample").orderBy("row_id")
    return records(spark, folder).withColumn("nth", F.row_number().over(w)).groupBy("contig", "pos", "nth").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("row_id").alias("row_ids"))


@query(f"with {V}, u as (select contig, pos, unnest(alleles) as a from v) select contig, pos, list_sort(list(distinct a)) as alleles from u group by contig, pos")
def merge_alleles_union(spark: SparkSession, folder: str) -> DataFrame:
    """All alleles seen at a position, each once."""
    return records(spark, folder).groupBy("contig", "pos").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("alleles")))).alias("alleles"))


@query("select row_id, contig, start_pos as pos, sample from data_array order by contig, start_pos, sample, row_id limit 100")
def top_limit(spark: SparkSession, folder: str) -> DataFrame:
    """A read with a limit (the feature here), in order."""
    return select.limited(records(spark, folder), 100, ["contig", "pos", "sample", "row_id"]).select("row_id", "contig", "pos", "sample")


@query("select sample from (select sample, ntile(3) over (order by sample) as part from (select distinct sample from data_array where sample is not null)) where part = 2")
def sample_partition(spark: SparkSession, folder: str) -> DataFrame:
    """The middle third of the samples."""
    return select.sample_partition(records(spark, folder), 1, 3)


@query(f"with {R} select contig, lo, hi, line from (select *, ntile(4) over (order by contig, lo, hi, line) as part from r) where part = 1")
def region_partition(spark: SparkSession, folder: str) -> DataFrame:
    """The first quarter of the regions."""
    return select.region_partition(regions(spark, folder), 0, 4)


@query(f"with {COUNTS.replace('from data_array', 'from data_array where sample <> ' + repr(SAMPLES[0]))} select * from q")
def delete_sample_negate(spark: SparkSession, folder: str) -> DataFrame:
    """Allele counts after a sample was taken back by negated partials."""
    r = records(spark, folder)
    whole = stats.allele_count(r)
    gone = stats.negated(stats.allele_count(r.where(F.col("sample") == SAMPLES[0])), ("count",))
    return stats.sum_allele_counts(whole.unionByName(gone))


@query("select row_id from data_array where ingest_ts <= timestamp '2024-01-03 12:00:00'")
def time_travel(spark: SparkSession, folder: str) -> DataFrame:
    """The records as of a time."""
    return select.as_of(records(spark, folder), end_ms=1_704_283_200_000).select("row_id")


@query(f"with {V}, {R} select v.row_id, r.line as region_line from v join r on {MEET}")
def anchor_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    """The overlap found by bins instead of bounds: the same pairs."""
    return overlap_join_binned(records(spark, folder), regions(spark, folder)).select("row_id", "region_line")


@query("""select row_id, case when length(alleles[1]) > 1 and length(alleles[2]) > 1 and right(alleles[1], 1) = right(alleles[2], 1) and not starts_with(alleles[2], '<') then alleles[1][:-2] || ',' || alleles[2][:-2]
 else alleles[1] || ',' || alleles[2] end as normalized from data_array where len(alleles) > 1""")
def normalize_alleles(spark: SparkSession, folder: str) -> DataFrame:
    """Reference and first alternate without a shared last base."""
    return records(spark, folder).where(F.size("alleles") > 1).select("row_id", A.trim_one(F.element_at("alleles", 1), F.element_at("alleles", 2)).alias("normalized"))


@query(f"with {V} select row_id, {FORM} as gt_form from v where gt is not null")
def gt_normal_form(spark: SparkSession, folder: str) -> DataFrame:
    """Normal forms of genotypes."""
    return records(spark, folder).where("gt is not null").select("row_id", A.gt_form(F.col("gt")).alias("gt_form"))


@query(f"""with x as (select contig, alleles, 1 as a from data_array where len(alleles) > 1)
select contig, count(*) filter ({SNP}) as n_snp, count(*) filter ({SNP} and {TI}) as n_ti, count(*) filter ({SNP} and not {TI}) as n_tv from x group by contig""")
def ti_tv(spark: SparkSession, folder: str) -> DataFrame:
    """Transitions and transversions per contig."""
    r, a = F.element_at("alleles", 1), F.element_at("alleles", 2)
    snp = A.is_snp(r, a)
    rows = records(spark, folder).where(F.size("alleles") > 1)
    return rows.groupBy("contig").agg(F.count_if(snp).alias("n_snp"), F.count_if(snp & A.is_transition(r, a)).alias("n_ti"), F.count_if(snp & ~A.is_transition(r, a)).alias("n_tv"))


@query("select contig, count(*) as n_records from data_array group by contig")
def contig_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each contig."""
    return records(spark, folder).groupBy("contig").agg(F.count(F.lit(1)).alias("n_records"))


@query("select contig, max(end_pos - start_pos + 1) as max_length from data_array where end_pos >= start_pos group by contig")
def max_variant_length(spark: SparkSession, folder: str) -> DataFrame:
    """The longest record of each contig."""
    return stats.max_variant_length(records(spark, folder))


@query("select contig, start_pos as pos, sample, count(*) as n from data_array group by contig, start_pos, sample having count(*) > 1")
def duplicates_check(spark: SparkSession, folder: str) -> DataFrame:
    """Positions where a sample has several records."""
    return records(spark, folder).groupBy("contig", "pos", "sample").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"with {SITES} select contig, pos, alleles, cast(ac as integer) as ac, cast(an as integer) as an from t where an > 0 and alleles <> 'ref' and least(ac, an - ac) >= 0.2 * an")
def maf_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Alternates whose minor allele frequency is 0.2 or more."""
    s = stats.variant_stats(stats.variant_stats_partial(records(spark, folder)), drop_ref=True)
    return association.maf_filter(s, 0.2).select("contig", "pos", "alleles", "ac", "an")


@query(f"""with {CALLS}, e as (select distinct contig, pos, allele, sample from k where a > 0),
tr as (select sample, sum(n_records) % 2 = 0 as trait from sample_stats where sample is not null group by sample),
n as (select count(*) filter (trait) as w, count(*) filter (not trait) as wo from tr),
m as (select contig, pos, allele, count(*) filter (trait) as a, count(*) filter (not trait) as b from e join tr using (sample) group by contig, pos, allele),
f as (select m.*, w - a as c, wo - b as d from m, n)
select contig, pos, allele, a, b, c, d, round(cast(a + b + c + d as double) * power(cast(a * d - b * c as double), 2) / nullif(cast(a + b as double) * (c + d) * (a + c) * (b + d), 0), 6) as chi2 from f""")
def assoc_chisq(spark: SparkSession, folder: str) -> DataFrame:
    """Association of alternates with a trait made from the run counters."""
    traits = table(spark, folder, "sample_stats").where("sample is not null").groupBy("sample").agg((F.sum("n_records") % 2 == 0).alias("trait"))
    return association.chi_square(association.carriers(records(spark, folder)), traits).withColumn("chi2", F.round("chi2", 6))


@query("""select sample as "SAMPLE", alleles[1] as "REF", array_to_string(alleles[2:], ',') as "ALT", cast(start_pos + 1 as varchar) as "POS", contig as "CHR", coalesce(array_to_string(filter_ids, ';'), '') as "FILTER", coalesce(nullif(regexp_extract(fmt, '(^|;)AD=([^;]*)', 2), ''), '.') as "S:AD" from data_array""")
def tsv_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of a tab-separated export."""
    r = records(spark, folder).withColumns({"fmt": parse_map(F.col("fmt")), "info": parse_map(F.col("info"))})
    return r.select(*tsv_columns(["REF", "ALT", "POS", "CHR", "FILTER", "S:AD"]))


@query("select count(*) as n_rows, (select count(*) from (select distinct contig, start_pos, end_pos, sample, alleles from data_array)) as n_unique from data_array")
def unique_vs_total(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, and rows that differ."""
    r = records(spark, folder)
    whole = r.groupBy("contig", "pos", "end_pos", "sample", "alleles").agg(F.count(F.lit(1)).alias("n"))
    return whole.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"))


@query("select sample, md5(string_agg(header, '|' order by uri_id)) as header_md5, count(*) as n_headers from vcf_headers group by sample")
def header_digest(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of each sample's headers."""
    h = table(spark, folder, "vcf_headers").groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("uri_id", "header"))).alias("h"))
    return h.select("sample", F.md5(F.array_join(F.transform("h", lambda x: x["header"]), "|")).alias("header_md5"), F.size("h").cast("long").alias("n_headers"))


@query("select contig, sample, count(*) as n, grouping(contig) as no_contig, grouping(sample) as no_sample from data_array group by cube (contig, sample)")
def count_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by contig and sample with all subtotals."""
    return table(spark, folder, "data_array").cube("contig", "sample").agg(F.count(F.lit(1)).alias("n"), F.grouping("contig").cast("long").alias("no_contig"), F.grouping("sample").cast("long").alias("no_sample"))


@query()
def cohort_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Cohort records: the k-th records of all samples at a position as one, alleles and genotypes brought together."""
    r = records(spark, folder).withColumns({"info": parse_map(F.col("info")), "fmt": parse_map(F.col("fmt"))})
    gt = F.array_join(F.transform("gt", lambda g: F.when(g < 0, ".").otherwise(g.cast("string"))), "/")
    r = r.withColumn("fmt", F.when(F.col("gt").isNotNull(), F.map_concat(F.map_filter("fmt", lambda k, _: k != "GT"), F.create_map(F.lit("GT"), gt))).otherwise(F.col("fmt")))
    fields = [Field("info", "MLEAC", "Integer", "A"), Field("info", "MLEAF", "Float", "A"), Field("fmt", "AD", "Integer", "R")]
    return merge_cohort(r, fields).select("contig", "pos", "nth", "id", "alleles", F.map_keys("calls").alias("samples"), F.element_at("info", "AC").alias("ac"), F.element_at("info", "AN").alias("an"))


@query("""select cast(date_trunc('day', ingest_ts) as date) as day, contig, count(*) as n_records from data_array group by 1, 2""")
def stream_daily_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records per contig and day, kept by a stream over the table's files."""
    source = spark.readStream.schema(table(spark, folder, "data_array").schema).parquet(f"{folder}/data_array.parquet*")
    name = f"allelake_{uuid.uuid4().hex}"
    # The sink holds a row per contig and day.
    windowed_records(source, late="3650 days").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("date").alias("day"), "contig", "n_records")
