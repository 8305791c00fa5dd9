"""Aggregates over records: allele counts, per-site variant statistics, per-sample counters and quality.

Input is a table of records: ``contig, pos, end_pos, sample, alleles, filters, gt``
and, for the per-sample counters, ``dp`` and ``gq``. Every first step is a partial
aggregate that can be appended and summed again, so new batches and deletions
(negated partials) need no rereading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelake.functions import alleles as A

#: The counters of a run, in their order in the table.
COUNTERS = (
    "dp_sum", "dp_sum2", "dp_count", "dp_min", "dp_max", "gq_sum", "gq_sum2", "gq_count", "gq_min", "gq_max",
    "n_records", "n_called", "n_not_called", "n_hom_ref", "n_het", "n_singleton", "n_snp", "n_transition", "n_transversion",
    "n_insertion", "n_deletion", "n_star", "n_multiallelic",
)


def allele_count(records: DataFrame) -> DataFrame:
    """``contig, pos, ref, alt, filter, gt, count`` of genotypes with one or two alleles that call an alternate one.

    Left out: null genotypes, allele numbers beyond the record's alleles, all
    missing, reference only, higher ploidies.
    """
    called = records.where(A.valid_gt(F.col("gt"), F.col("alleles")) & F.size("gt").between(1, 2)).select(
        "contig", "pos", F.element_at("alleles", 1).alias("ref"), A.alt_text(F.col("alleles"), F.col("gt")).alias("alt"), A.filter_text(F.col("filters")).alias("filter"), A.gt_form(F.col("gt")).alias("gt")
    )
    return called.where("gt is not null").groupBy("contig", "pos", "ref", "alt", "filter", "gt").agg(F.count(F.lit(1)).cast("int").alias("count"))


def sum_allele_counts(partials: DataFrame) -> DataFrame:
    """Partials (of batches, and negated ones of deletions) summed; keys that come to 0 are left out."""
    return partials.groupBy("contig", "pos", "ref", "alt", "filter", "gt").agg(F.sum("count").cast("int").alias("count")).where("count <> 0")


def variant_stats_partial(records: DataFrame, version: int = 2) -> DataFrame:
    """``contig, pos, end_pos, sample, allele, ac, an, n_hom``: calls per site, sample and allele.

    Version 3 trims a shared last base and counts reference blocks under ``nr``;
    version 2 has a ``ref`` row, if need be of 0, for every counted record.
    Records without a call or with an allele number beyond their alleles are
    left out. Any ploidy counts.
    """
    if version not in (2, 3):
        raise ValueError("version must be 2 or 3")
    good = records.where(A.has_call(F.col("gt")) & A.valid_gt(F.col("gt"), F.col("alleles")))
    block = A.is_block(F.col("alleles"), F.col("gt")) if version == 3 else F.lit(False)
    calls = F.filter("gt", lambda g: g >= 0)
    keyed = good.select(
        "contig", "pos", "end_pos", "sample", "alleles", F.size("gt").alias("an"), A.is_homozygous(F.col("gt")).alias("hom"), block.alias("block"),
        F.element_at("gt", 1).alias("first"), calls.alias("calls"), F.array_distinct(calls).alias("seen"),
    )
    if version == 2:
        keyed = keyed.withColumn("seen", F.array_union("seen", F.array(F.lit(0))))
    rows = keyed.withColumn("g", F.explode("seen"))
    key = A.allele_key(F.col("alleles"), F.col("g"), version == 3)
    if version == 3:
        key = F.when((F.col("g") == 0) & F.col("block"), F.lit(A.BLOCK_KEY)).otherwise(key)
    return rows.groupBy("contig", "pos", "end_pos", "sample", key.alias("allele")).agg(
        F.sum(F.expr("size(filter(calls, x -> x = g))")).cast("int").alias("ac"),
        F.max("an").cast("int").alias("an"),
        F.sum((F.col("hom") & (F.col("g") == F.col("first"))).cast("int")).cast("int").alias("n_hom"),
    )


def variant_stats(partials: DataFrame, samples: int | None = None, drop_ref: bool = False) -> DataFrame:
    """``contig, pos, alleles, ac, an, af`` from partials.

    ``an`` is the calls at the site (blocks aside), or twice ``samples`` where given.
    Sites whose calls come to 0 (deleted samples) are left out, and so are
    alternates that nobody has any more; a ``ref`` row of 0 stays.
    """
    sites = partials.where(F.col("allele") != A.BLOCK_KEY).groupBy("contig", "pos", F.col("allele").alias("alleles")).agg(F.sum("ac").cast("int").alias("ac"))
    at = Window.partitionBy("contig", "pos")
    an = F.lit(2 * samples) if samples is not None else F.sum("ac").over(at)
    out = sites.withColumn("an", an.cast("int")).where((F.col("an") > 0) & ((F.col("ac") > 0) | (F.col("alleles") == A.REF_KEY))).withColumn("af", (F.col("ac") / F.col("an")).cast("float"))
    return out.where(F.col("alleles") != A.REF_KEY) if drop_ref else out


def max_variant_length(records: DataFrame) -> DataFrame:
    """``contig, max_length``: the longest record, the bound that lets a range read start at ``lo - max_length``."""
    return records.where("end_pos >= pos").groupBy("contig").agg(F.max(F.col("end_pos") - F.col("pos") + 1).alias("max_length"))


def sample_stats(records: DataFrame) -> DataFrame:
    """One row per sample with the 23 counters of :data:`COUNTERS`, partials that sum, min and max combine.

    Alternate alleles count once per called copy. A record without a genotype, or
    with missing alleles only, is not called; one with an allele number beyond
    its alleles is counted as a record and for depth only. Null depths are skipped.
    """
    gt = F.col("gt")
    valid, called = A.valid_gt(gt, F.col("alleles")), A.has_call(gt)
    use = valid & called
    # Each called copy is classified once; the counters below only compare small numbers.
    kinds = F.transform(F.filter("gt", lambda g: g > 0), lambda g: A.allele_kind(F.element_at("alleles", 1), F.get("alleles", g)))
    records = records.select("sample", "dp", "gq", "gt", "alleles", F.when(use, kinds).alias("__kinds"), F.when(use, F.filter("gt", lambda g: g > 0)).alias("__alts"))
    of = lambda *which: F.size(F.filter("__kinds", lambda k: k.isin(*which)))
    ones = F.size(F.filter("__alts", lambda g: F.size(F.array_remove(F.col("__alts"), g)) == F.size("__alts") - 1))
    flags = {
        "n_records": F.lit(1),
        "n_called": F.when(use, 1),
        "n_not_called": F.when(~called, 1),
        "n_hom_ref": F.when(use & F.forall("gt", lambda g: g == 0), 1),
        "n_het": F.when(use & F.forall("gt", lambda g: g >= 0) & F.exists("gt", lambda g: g != F.element_at("gt", 1)), 1),
        "n_singleton": ones,
        "n_snp": of(A.TRANSITION, A.TRANSVERSION),
        "n_transition": of(A.TRANSITION),
        "n_transversion": of(A.TRANSVERSION),
        "n_insertion": of(A.INSERTION),
        "n_deletion": of(A.DELETION),
        "n_star": of(A.STAR),
        "n_multiallelic": F.when(F.size("alleles") > 2, 1),
    }
    wide = records.select("sample", *(F.col(c).cast("long").alias(c) for c in ("dp", "gq")), *(f.cast("long").alias(n) for n, f in flags.items()))
    depth = [x for c in ("dp", "gq") for x in (F.sum(c).alias(f"{c}_sum"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_sum2"), F.count(c).alias(f"{c}_count"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    return wide.groupBy("sample").agg(*depth, *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in flags))


def sum_sample_stats(partials: DataFrame) -> DataFrame:
    """Counters of several runs as one row per sample: min and max by name, else sums. Nulls are skipped."""
    agg = {"min": F.min, "max": F.max}
    return partials.groupBy("sample").agg(*(agg.get(c.rpartition("_")[2], F.sum)(c).alias(c) for c in COUNTERS))


def sample_qc(partials: DataFrame) -> DataFrame:
    """Per-sample quality from counters: means, population deviations, rates and ratios.

    A mean is null without values, a deviation for fewer than two, a ratio where
    the denominator is 0; extremes without values are 0.
    """
    s = sum_sample_stats(partials)
    per = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))

    def spread(c: str) -> Column:
        mean = per(f"{c}_sum", f"{c}_count")
        return F.when(F.col(f"{c}_count") > 1, F.sqrt(F.greatest(per(f"{c}_sum2", f"{c}_count") - mean * mean, F.lit(0.0))))

    s = s.withColumns({"n_hom_var": F.expr("n_called - n_hom_ref - n_het"), "n_non_ref": F.expr("n_called - n_hom_ref"), "__all": F.expr("n_called + n_not_called")})
    return s.select(
        "sample",
        *(x.cast("float").alias(n) if n.endswith(("mean", "stddev")) else x.alias(n) for c in ("dp", "gq") for n, x in ((f"{c}_mean", per(f"{c}_sum", f"{c}_count")), (f"{c}_stddev", spread(c)), (f"{c}_min", F.coalesce(f"{c}_min", F.lit(0))), (f"{c}_max", F.coalesce(f"{c}_max", F.lit(0))))),
        per("n_called", "__all").cast("float").alias("call_rate"),
        "n_called", "n_not_called", "n_hom_ref", "n_het", "n_hom_var", "n_non_ref", "n_singleton", "n_snp", "n_insertion", "n_deletion", "n_transition", "n_transversion", "n_star",
        per("n_transition", "n_transversion").cast("float").alias("r_ti_tv"),
        per("n_het", "n_hom_var").cast("float").alias("r_het_hom_var"),
        per("n_insertion", "n_deletion").cast("float").alias("r_insertion_deletion"),
        "n_records", "n_multiallelic",
    )


def negated(partials: DataFrame, counts: tuple[str, ...]) -> DataFrame:
    """Partials that take the given ones back when summed with them."""
    return partials.withColumns({c: (-F.col(c)).cast(partials.schema[c].dataType) for c in counts})
