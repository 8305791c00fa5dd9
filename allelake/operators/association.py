"""Case-control association of variants: frequency filter and chi-square test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelake.functions import alleles as A


def carriers(records: DataFrame) -> DataFrame:
    """``contig, pos, allele, sample``: the samples that carry each alternate allele, each once."""
    good = records.where(A.valid_gt(F.col("gt"), F.col("alleles")))
    called = good.select("contig", "pos", "alleles", "sample", F.explode(F.array_distinct(F.filter("gt", lambda g: g > 0))).alias("g"))
    return called.select("contig", "pos", A.allele_key(F.col("alleles"), F.col("g")).alias("allele"), "sample").distinct()


def maf_filter(stats: DataFrame, least: float) -> DataFrame:
    """Rows of variant statistics whose minor allele frequency is at least ``least``."""
    return stats.where(F.least("ac", F.col("an") - F.col("ac")) >= least * F.col("an"))


def chi_square(carried: DataFrame, traits: DataFrame) -> DataFrame:
    """Per variant the 2x2 table of carriers and trait, and its chi-square: ``contig, pos, allele, a, b, c, d, chi2``.

    ``traits``: ``sample, trait`` (boolean), a row per sample; samples without one
    don't count. a, b: carriers with and without the trait; c, d: the others.
    chi2 is null where a margin is 0.
    """
    known = traits.where("trait is not null")
    totals = known.agg(F.count_if("trait").alias("with_trait"), F.count_if(~F.col("trait")).alias("without_trait"))
    cells = carried.join(known, "sample").groupBy("contig", "pos", "allele").agg(F.count_if("trait").alias("a"), F.count_if(~F.col("trait")).alias("b"))
    table = cells.crossJoin(F.broadcast(totals)).withColumns({"c": F.expr("with_trait - a"), "d": F.expr("without_trait - b")})  # totals: one row
    n, det = F.expr("cast(a + b + c + d as double)"), F.expr("cast(a * d - b * c as double)")
    return table.withColumn("chi2", F.try_divide(n * det * det, F.expr("cast(a + b as double) * (c + d) * (a + c) * (b + d)"))).select("contig", "pos", "allele", "a", "b", "c", "d", "chi2")
