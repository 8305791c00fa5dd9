"""Records as tab-separated tables, per-sample variant files and merged variant files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelake.functions.alleles import filter_text

#: Plain fields of a TSV export and what they hold.
PLAIN = {
    "ID": lambda: F.coalesce("id", F.lit(".")),
    "REF": lambda: F.element_at("alleles", 1),
    "ALT": lambda: F.array_join(F.slice("alleles", 2, F.greatest(F.size("alleles") - 1, F.lit(0))), ","),
    "QUAL": lambda: F.col("qual").cast("string"),
    "POS": lambda: (F.col("pos") + 1).cast("string"),
    "CHR": lambda: F.col("contig"),
    "FILTER": lambda: F.coalesce(F.array_join("filters", ";"), F.lit("")),
    "Q:POS": lambda: (F.col("region_lo") + 1).cast("string"),
    "Q:END": lambda: (F.col("region_hi") + 1).cast("string"),
    "Q:LINE": lambda: F.col("region_line").cast("string"),
}


def tsv_columns(fields: Sequence[str]) -> list[Column]:
    """Columns of a TSV export, ``SAMPLE`` first. ``I:x`` and ``F:x`` (or ``S:x``) name INFO and FORMAT fields; absent ones are ``.``."""
    out = [F.col("sample").alias("SAMPLE")]
    for f in dict.fromkeys(fields):
        if f == "SAMPLE":
            continue
        if f in PLAIN:
            out.append(PLAIN[f]().alias(f))
        elif f[:2] in ("I:", "F:", "S:") and len(f) > 2:
            out.append(F.coalesce(F.element_at("info" if f[0] == "I" else "fmt", f[2:]), F.lit(".")).alias(f))
        else:
            raise ValueError(f"no field {f!r}")
    return out


def write_tsv(records: DataFrame, fields: Sequence[str], path: str) -> None:
    """A header line per part file and one line per record; parts stand in a folder."""
    records.select(*tsv_columns(fields)).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "").csv(path)


def info_text(info: Column) -> Column:
    """A map as ``k=v;flag``, sorted; ``.`` for none."""
    entries = F.array_sort(F.map_entries(info))
    parts = F.transform(entries, lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.coalesce(F.size(info), F.lit(0)) > 0, F.array_join(parts, ";")).otherwise(F.lit("."))


def vcf_line(end_declared: bool = True) -> Column:
    """A record as a line of its sample's file. A record whose end isn't its reference's gets END back if the header declares it."""
    info = F.col("info")
    if end_declared:
        longer = F.col("end_pos") + 1 != F.col("pos") + F.length(F.element_at("alleles", 1))
        lost = ~F.coalesce(F.map_contains_key("info", "END"), F.lit(False))
        info = F.when(longer & lost, F.map_concat(F.coalesce("info", F.expr("cast(map() as map<string,string>)")), F.create_map(F.lit("END"), (F.col("end_pos") + 1).cast("string")))).otherwise(info)
    keys = F.map_keys("fmt")
    keys = F.concat(F.filter(keys, lambda k: k == "GT"), F.array_sort(F.filter(keys, lambda k: k != "GT")))
    alts = F.slice("alleles", 2, F.greatest(F.size("alleles") - 1, F.lit(0)))
    fixed = F.concat_ws(
        "\t", "contig", (F.col("pos") + 1).cast("string"), F.coalesce("id", F.lit(".")), F.element_at("alleles", 1), F.when(F.size(alts) > 0, F.array_join(alts, ",")).otherwise("."),
        F.coalesce(F.col("qual").cast("string"), F.lit(".")), filter_text(F.col("filters")), info_text(info),
    )
    return F.when(F.coalesce(F.size("fmt"), F.lit(0)) > 0, F.concat_ws("\t", fixed, F.array_join(keys, ":"), F.array_join(F.transform(keys, lambda k: F.element_at("fmt", k)), ":"))).otherwise(fixed)


def write_sample_vcfs(records: DataFrame, headers: DataFrame, path: str, compression: str = "none") -> None:
    """A folder ``sample=<name>`` per sample with its header and records in order.

    Samples are cut into position ranges, so one with most records is written by
    many tasks; part files of a folder, in name order, give the file.
    """
    body = records.select("sample", F.lit(1).alias("kind"), "contig", "pos", vcf_line().alias("value"))
    top = F.concat(F.col("header"), F.lit("\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"), F.when(F.col("sample") != "", F.concat(F.lit("\tFORMAT\t"), "sample")).otherwise(""))
    head = headers.join(records.select("sample").distinct(), "sample", "left_semi").select("sample", F.lit(0).alias("kind"), F.lit("").alias("contig"), F.lit(-1).alias("pos"), top.alias("value"))
    ordered = head.unionByName(body).repartitionByRange("sample", "kind", "contig", "pos").sortWithinPartitions("sample", "kind", "contig", "pos")
    ordered.select("sample", "value").write.mode("overwrite").partitionBy("sample").option("compression", compression).text(path)


def cohort_lines(cohort: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Lines of a merged file: ``contig, pos, nth, value``, a column per sample, missing ones as ``.``."""
    alts = F.slice("alleles", 2, F.greatest(F.size("alleles") - 1, F.lit(0)))
    empty = F.array_join(F.transform("format", lambda k: F.when(k == "GT", F.lit("./.")).otherwise(F.lit("."))), ":")
    fixed = F.concat_ws(
        "\t", "contig", (F.col("pos") + 1).cast("string"), "id", F.element_at("alleles", 1), F.when(F.size(alts) > 0, F.array_join(alts, ",")).otherwise("."),
        F.coalesce(F.col("qual").cast("string"), F.lit(".")), filter_text(F.col("filters")), info_text(F.col("info")), F.when(F.size("format") > 0, F.array_join("format", ":")).otherwise("."),
    )
    names = cohort.sparkSession.sparkContext.broadcast(list(samples))  # the file's column line holds them all anyway

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = names.value
        for batch in batches:
            *keys, fixed, empty, calls = (batch.column(i) for i in range(6))
            text = []
            for head, none, own in zip(fixed.to_pylist(), empty.to_pylist(), calls.to_pylist()):
                there = {c["key"]: c["value"] for c in own}
                text.append("\t".join([head, *(there.get(s, none) for s in order)]))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(text, pa.string())], names=["contig", "pos", "nth", "value"])

    parts = cohort.select("contig", "pos", "nth", fixed.alias("fixed"), empty.alias("empty"), F.map_entries("calls").alias("calls"))
    return parts.mapInArrow(lines, "contig string, pos int, nth int, value string")


def write_cohort_vcf(cohort: DataFrame, samples: Sequence[str], header: str, path: str) -> None:
    """A merged file as range-sorted parts; the first has the header."""
    top = header.rstrip("\n") + "\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(samples)
    lines = cohort_lines(cohort, samples)
    head = cohort.sparkSession.createDataFrame([("", -1, 0, top)], lines.schema)
    head.unionByName(lines).repartitionByRange("contig", "pos", "nth").sortWithinPartitions("contig", "pos", "nth").select("value").write.mode("overwrite").text(path)
