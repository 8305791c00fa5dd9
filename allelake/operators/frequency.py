"""Allele frequencies on reads: filter and annotation."""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelake.functions import alleles as A
from allelake.operators.overlap import stab_sums

_OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


def parse_af_filter(text: str) -> tuple[str, float]:
    """``<0.2``, ``>= 0.05``: operator and threshold. Raises ValueError for anything else."""
    m = re.fullmatch(r"\s*(<=|>=|==|!=|<|>)\s*([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)\s*", text or "")
    if not m:
        raise ValueError(f"an allele frequency filter is an operator (< <= > >= == !=) and a number, not {text!r}")
    return m[1], float(m[2])


def site_counts(partials: DataFrame, version: int = 2) -> DataFrame:
    """``contig, pos, an, ac_of`` per site: calls and a map from allele key to its calls.

    Version 3 adds reference blocks that cover the site to ``an`` and to ``ref``.
    """
    own = partials.where(F.col("allele") != A.BLOCK_KEY).groupBy("contig", "pos", "allele").agg(F.sum("ac").alias("ac"))
    sites = own.groupBy("contig", "pos").agg(F.sum("ac").alias("an"), F.map_from_entries(F.collect_list(F.struct("allele", "ac"))).alias("ac_of"))
    if version < 3:
        return sites
    blocks = partials.where(F.col("allele") == A.BLOCK_KEY).select("contig", F.col("pos").alias("lo"), F.col("end_pos").alias("hi"), F.col("an").alias("b_an"), F.col("ac").alias("b_ac"))
    sums = stab_sums(sites, blocks, ["b_an", "b_ac"])
    both = sites.join(sums, ["contig", "pos"], "left")
    ref = F.coalesce(F.element_at("ac_of", A.REF_KEY), F.lit(0)) + F.coalesce("b_ac", F.lit(0))
    return both.select("contig", "pos", (F.col("an") + F.coalesce("b_an", F.lit(0))).alias("an"), F.map_concat(F.map_filter("ac_of", lambda k, _: k != A.REF_KEY), F.create_map(F.lit(A.REF_KEY), ref)).alias("ac_of"))


def annotate(records: DataFrame, partials: DataFrame, samples: int | None = None, version: int = 2) -> DataFrame:
    """Add ``iaf`` (array<float>), ``iac`` (array<int>) and ``ian`` (int): frequency and calls of each of a record's alleles at its site.

    Null where the site has no calls at all; 0 for alleles that nobody has and
    for the symbolic one. ``samples``: take ``an`` as twice this number.
    """
    sites = site_counts(partials, version).select(F.col("contig").alias("__c"), F.col("pos").alias("__p"), "an", "ac_of")
    joined = records.join(sites, (F.col("contig") == F.col("__c")) & (F.col("pos") == F.col("__p")), "left")
    an = F.lit(2 * samples) if samples is not None else F.col("an")

    def ac(a: Column, i: Column) -> Column:
        return F.when(a == A.NON_REF, 0).otherwise(F.coalesce(F.element_at("ac_of", A.allele_key(F.col("alleles"), i, version == 3)), F.lit(0))).cast("int")

    out = joined.withColumn("iac", F.when(F.col("an").isNotNull(), F.transform("alleles", ac))).withColumn("ian", F.when(F.col("an").isNotNull(), an).cast("int"))
    return out.withColumn("iaf", F.transform("iac", lambda x: (x / F.col("ian")).cast("float"))).drop("__c", "__p", "an", "ac_of")


def af_filter(records: DataFrame, partials: DataFrame, condition: str, samples: int | None = None, version: int = 2) -> DataFrame:
    """Annotated records of which any called allele's frequency meets ``condition``, or whose alleles are all missing.

    A record without a genotype, or at a site without counts, fails. The symbolic
    allele fails. Frequencies are compared in single precision.
    """
    op, threshold = parse_af_filter(condition)
    out = annotate(records, partials, samples, version)
    passes = F.exists("gt", lambda g: (g >= 0) & (F.get("alleles", g) != A.NON_REF) & _OPS[op](F.get("iaf", g), F.lit(threshold).cast("float")))
    missing = (F.size("gt") > 0) & F.forall("gt", lambda g: g < 0)
    return out.where(F.coalesce(missing, F.lit(False)) | (F.col("iaf").isNotNull() & F.coalesce(passes, F.lit(False))))
