"""Files delivered again: which listings repeat others, and every record once.

A file is redundant if each of its records is in another file. Files with equal
record sets form one class (by a 128-bit set signature); classes are compared
through each class's rarest record, so a record that many files hold is not
expanded into pairs of files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from allelake.session import written


def record_key(rows: DataFrame, cols: Sequence[str]) -> tuple[Column, Column]:
    """128 bits that stand for a record; null differs from every value, in arrays too, where plain hashing would pass it over."""
    parts = []
    for c in cols:
        if isinstance(rows.schema[c].dataType, ArrayType):
            parts += [F.size(c), F.array_join(c, "\x01", "\x00")]
        else:
            parts.append(F.struct(F.col(c).isNull(), F.col(c)))
    return F.xxhash64(*parts), F.xxhash64(F.lit("allelake"), *reversed(parts))


def file_records(rows: DataFrame, file: str, record: Sequence[str]) -> DataFrame:
    """Distinct ``file, h1, h2``. Rows without a file are left out."""
    h1, h2 = record_key(rows, record)
    return rows.where(F.col(file).isNotNull()).select(F.col(file).alias("file"), h1.alias("h1"), h2.alias("h2")).distinct()


def contained_files(rows: DataFrame, file: str, record: Sequence[str]) -> DataFrame:
    """Pairs ``inner, outer``: every record of file ``inner`` is also in file ``outer``, which is another file.

    Of files with equal record sets each names every other. Repeated rows count
    once; nulls in record columns equal each other; an empty table gives no rows.
    """
    records = written(file_records(rows, file, record), "records")
    often = records.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Only records that several files hold go on, and of files only those that hold no other record.
    held = written(records.join(often, ["h1", "h2"]), "held")
    sizes = records.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    sets = held.groupBy("file").agg(F.count(F.lit(1)).alias("shared"), F.expr("bit_xor(xxhash64(h1, h2))").alias("s1"), F.expr("bit_xor(xxhash64(h2, h1, 7))").alias("s2"), F.min(F.struct("df", "h1", "h2")).alias("rarest"))
    sets = written(sets.join(sizes, "file").where("shared = n").select("file", "n", "s1", "s2", "rarest"), "sets")
    classes = sets.groupBy("n", "s1", "s2").agg(F.min("file").alias("rep"))
    members = written(sets.join(classes, ["n", "s1", "s2"]).select("file", "rep", "n", "rarest"), "members")
    inner = members.where("file = rep").select(F.col("file").alias("inner"), F.col("n").alias("n_inner"), "rarest.h1", "rarest.h2")
    # Copies stand back for their class; the other files stand for themselves.
    outer = held.join(members.where("file <> rep").select("file"), "file", "left_anti").select(F.col("file").alias("outer"), "h1", "h2")
    candidates = inner.join(outer, ["h1", "h2"]).where("inner <> outer").select("inner", "outer", "n_inner")
    of_inner = held.select(F.col("file").alias("inner"), "h1", "h2")
    proper = candidates.join(of_inner, "inner").join(outer, ["outer", "h1", "h2"]).groupBy("inner", "outer", "n_inner").agg(F.count(F.lit(1)).alias("both")).where("both = n_inner").select("inner", "outer")
    equal = members.select(F.col("file").alias("inner"), "rep").join(members.select(F.col("file").alias("outer"), "rep"), "rep").where("inner <> outer").select("inner", "outer")
    expanded = (
        proper.join(members.select(F.col("file").alias("i"), F.col("rep").alias("inner")), "inner")
        .join(members.select(F.col("file").alias("o"), F.col("rep").alias("outer")), "outer", "left")
        .select(F.col("i").alias("inner"), F.coalesce("o", "outer").alias("outer"))
    )
    return equal.unionByName(expanded)


def redelivered(listing: DataFrame, rows: DataFrame, file: str, name: str, record: Sequence[str]) -> DataFrame:
    """Pairs of listings, smaller id first, that have the same ``name`` or of which one's records are all in the other's file.

    Columns ``<file>_1, <file>_2``, each pair once. Null names are no name; files
    that aren't listed and listings without an id are left out.
    """
    listed = listing.where(F.col(file).isNotNull()).select(F.col(file).alias("file"), F.col(name).alias("name"))
    same = listed.where("name is not null").alias("a").join(listed.alias("b"), F.expr("a.name = b.name and a.file < b.file")).select(F.col("a.file").alias("one"), F.col("b.file").alias("two"))
    held = contained_files(rows, file, record).select(F.least("inner", "outer").alias("one"), F.greatest("inner", "outer").alias("two"))
    ids = listed.select("file").distinct()
    held = held.join(ids.withColumnRenamed("file", "one"), "one", "left_semi").join(ids.withColumnRenamed("file", "two"), "two", "left_semi").select("one", "two")
    return same.unionByName(held).distinct().select(F.col("one").alias(f"{file}_1"), F.col("two").alias(f"{file}_2"))


def once(rows: DataFrame, record: Sequence[str], order: str) -> DataFrame:
    """One row per record, the one with the smallest ``order``; all columns are kept.

    A null ``order`` comes last; of rows that are equal in ``order`` too, any one is
    kept. Nulls in record columns equal each other. Repeated records are found on
    hashes and ``order`` alone; wide rows only meet the repeated ones: where those
    are few Spark broadcasts them, else rows are shuffled once, by record.
    """
    h1, h2 = record_key(rows, record)
    narrow = rows.select(h1.alias("__h1"), h2.alias("__h2"), F.col(order).alias("__keep")).groupBy("__h1", "__h2", "__keep").agg(F.count(F.lit(1)).alias("__n"))
    first = F.min(F.struct(F.col("__keep").isNull().alias("none"), "__keep", "__n"))
    repeated = narrow.groupBy("__h1", "__h2").agg(F.sum("__n").alias("__all"), first.alias("__first")).where("__all > 1")
    repeated = written(repeated.select("__h1", "__h2", "__first.__keep", "__first.__n"), "repeated")
    met = rows.withColumns({"__h1": h1, "__h2": h2}).join(repeated, ["__h1", "__h2"], "left")
    own = F.col(order).eqNullSafe(F.col("__keep"))
    out = met.where(F.col("__n").isNull() | (own & (F.col("__n") == 1))).select(*rows.columns)
    if repeated.where("__n > 1").isEmpty():
        return out
    return out.unionByName(met.where(own & (F.col("__n") > 1)).dropDuplicates(["__h1", "__h2"]).select(*rows.columns))
