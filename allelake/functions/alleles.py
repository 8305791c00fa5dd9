"""Column functions on alleles, genotypes and positions. Null in, null out unless stated."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The symbolic allele of reference blocks, and the keys of reference counts.
NON_REF, REF_KEY, BLOCK_KEY = "<NON_REF>", "ref", "nr"


def decode_gt(text: Column) -> Column:
    """``0/1``, ``.|1``, ``2`` to allele numbers, a missing one as -1. Phase is dropped. Text that is no number is missing too."""
    return F.transform(F.split(text, r"[/|]"), lambda a: F.coalesce(a.try_cast("int"), F.lit(-1)))


def end_position(pos: Column, ref: Column, end: Column) -> Column:
    """0-based inclusive end: a whole number END (1-based) wins, else the reference allele's length counts."""
    return F.coalesce(F.trim(end).try_cast("int") - 1, (pos + F.length(ref) - 1).cast("int"))


def trim_one(ref: Column, alt: Column) -> Column:
    """``ref,alt`` without one shared last base, where both have more than one base."""
    shared = (F.length(ref) > 1) & (F.length(alt) > 1) & (F.right(ref, F.lit(1)) == F.right(alt, F.lit(1))) & ~alt.startswith("<")
    cut = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
    return F.when(shared, F.concat(cut(ref), F.lit(","), cut(alt))).otherwise(F.concat(ref, F.lit(","), alt))


def allele_key(alleles: Column, number: Column, trimmed: bool = False) -> Column:
    """The key a count stands under: ``ref`` for allele 0, else ``ref,alt``."""
    ref, alt = F.element_at(alleles, 1), F.get(alleles, number)
    return F.when(number == 0, F.lit(REF_KEY)).otherwise(trim_one(ref, alt) if trimmed else F.concat(ref, F.lit(","), alt))


def has_call(gt: Column) -> Column:
    """Whether any allele is called; false for null and empty genotypes."""
    return F.coalesce(F.exists(gt, lambda g: g >= 0), F.lit(False))


def valid_gt(gt: Column, alleles: Column) -> Column:
    """Whether no allele number goes beyond the record's alleles."""
    return ~F.coalesce(F.exists(gt, lambda g: g >= F.size(alleles)), F.lit(False))


def is_homozygous(gt: Column) -> Column:
    """Whether all alleles are the same called one. A missing allele makes it false."""
    return F.coalesce(F.forall(gt, lambda g: (g >= 0) & (g == F.element_at(gt, 1))) & (F.size(gt) > 0), F.lit(False))


def is_block(alleles: Column, gt: Column) -> Column:
    """Whether a record is a reference block: two alleles, the second symbolic, first call 0."""
    return F.coalesce((F.size(alleles) == 2) & (F.get(alleles, F.lit(1)) == NON_REF) & (F.get(gt, F.lit(0)) == 0), F.lit(False))


def is_transition(ref: Column, alt: Column) -> Column:
    """A<->G and C<->T."""
    return F.concat(F.upper(ref), F.upper(alt)).isin("AG", "GA", "CT", "TC")


def is_snp(ref: Column, alt: Column) -> Column:
    """One base for another base."""
    base = lambda c: (F.length(c) == 1) & F.upper(c).isin("A", "C", "G", "T")
    return base(ref) & base(alt) & (F.upper(ref) != F.upper(alt))


#: Kinds of alternate alleles, as :func:`allele_kind` numbers them.
OTHER, TRANSITION, TRANSVERSION, INSERTION, DELETION, STAR = range(6)


def allele_kind(ref: Column, alt: Column) -> Column:
    """What an alternate allele is against the reference; symbolic ones and those of equal length other than single bases are ``OTHER``."""
    return (
        F.when(is_snp(ref, alt), F.when(is_transition(ref, alt), TRANSITION).otherwise(TRANSVERSION))
        .when(alt == "*", STAR)
        .when(alt.startswith("<"), OTHER)
        .when(F.length(alt) > F.length(ref), INSERTION)
        .when(F.length(alt) < F.length(ref), DELETION)
        .otherwise(OTHER)
    )


def filter_text(filters: Column) -> Column:
    """``a;b``, or ``.`` for none."""
    return F.when(F.coalesce(F.size(filters), F.lit(0)) > 0, F.array_join(filters, ";")).otherwise(F.lit("."))


def gt_form(gt: Column) -> Column:
    """Normal form of a genotype of one or two alleles: the called alleles numbered 1, 2 in order of first use, ``.`` first where one is missing.

    ``1`` (one allele), ``0,1``, ``1,1``, ``1,2``, ``.,1``; null for other ploidies and where no other allele than the reference is called.
    """
    a, b = F.get(gt, F.lit(0)), F.get(gt, F.lit(1))
    one = F.when(a > 0, F.lit("1"))
    two = (
        F.when((a < 0) & (b > 0) | (b < 0) & (a > 0), F.lit(".,1"))
        .when((a == 0) & (b > 0) | (b == 0) & (a > 0), F.lit("0,1"))
        .when((a > 0) & (a == b), F.lit("1,1"))
        .when((a > 0) & (b > 0), F.lit("1,2"))
    )
    return F.when(F.size(gt) == 1, one).when(F.size(gt) == 2, two)


def alt_text(alleles: Column, gt: Column) -> Column:
    """The called alternate alleles, distinct and sorted, joined by commas."""
    called = F.filter(gt, lambda g: g > 0)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(called, lambda g: F.get(alleles, g)))), ",")


def genotype_index(j: Column, k: Column) -> Column:
    """Place of the genotype of alleles j <= k in lists with one value per genotype."""
    return ((k * (k + 1)) / 2).cast("int") + j


def sample_name(name: Column) -> Column:
    """A name without blanks around; null where it is null or has a comma, tab or NUL. The empty name stands for annotation files."""
    cut = F.trim(name)
    return F.when(~cut.rlike("[,\t\\x00]"), cut)
