"""Single-sample variant files as tables of records and headers.

Text files (plain, gzip or block gzip) are read and parsed by Spark's own
functions; a file of any size is a stream of lines, scanned once. Headers are read
apart, a file's beginning only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.functions import alleles as A
from allelake.operators.drift import declarations
from allelake.sources.files import lines_of, listed, text_lines

#: Names of this many files at most are broadcast to the scan of their lines.
NAMED = 100_000

#: INFO and FORMAT fields that hold one number although others are lists.
SCALARS = ("fmt_DP", "fmt_GQ", "fmt_PS", "fmt_PQ", "fmt_MQ", "fmt_MIN_DP", "info_IAN")


@dataclass(frozen=True)
class Field:
    """A declared INFO or FORMAT field."""

    blob: str
    name: str
    kind: str
    number: str

    @property
    def column(self) -> str:
        return f"{self.blob}_{self.name}"

    def raw(self) -> Column:
        """The text in the blob's map."""
        return F.element_at(self.blob, self.name)

    def value(self, own_column: bool = False) -> Column:
        """The typed value from the blob's map or, with ``own_column``, from the column kept for it: flags 0 or 1, numbers as lists (some as scalars), text as it is; null where absent."""
        text = F.col(self.column) if own_column else self.raw()
        if self.kind == "Flag":
            return F.when(text.isNotNull(), 1).otherwise(0)
        if self.column == "fmt_GT":
            return F.col("gt")
        if self.kind not in ("Integer", "Float"):
            return text
        sql = "int" if self.kind == "Integer" else "float"
        if self.column in SCALARS:
            return text.try_cast(sql)
        return F.transform(F.split(text, ","), lambda x: x.try_cast(sql))


def header_fields(header: str) -> list[Field]:
    """The INFO and FORMAT fields of a header text, sorted."""
    return [Field(b, n, k, num) for b, n, k, num, _ in declarations(header)]


def header_contigs(header: str) -> dict[str, int]:
    """Contigs of a header and their lengths; one without a length has the greatest position there is."""
    out = {}
    for line in header.splitlines():
        if m := re.match(r"##contig=<(.*)>", line):
            name, size = re.search(r"(?:^|,)ID=([^,>]+)", m[1]), re.search(r"(?:^|,)length=(\d+)", m[1])
            if name:
                out[name[1]] = int(size[1]) if size else 2**32 - 2
    return out


def parse_map(text: Column, flag: str = "") -> Column:
    """``k=v;k2`` as a map; a key without a value gets ``flag``. Null, empty and ``.`` give an empty map; the last of equal keys counts."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: ~p.isin("", "."))
    entries = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(flag)).alias("v")))
    return map_of(entries)


def map_of(entries: Column) -> Column:
    """A map from an array of (k, v) where keys may repeat; the last of equal ones counts. Only rows that repeat a key pay for the search."""
    keys = F.transform(entries, lambda e: e["k"])
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(entries)).otherwise(F.map_from_entries(last))


def read_vcf(spark: SparkSession, paths: Sequence[str] | str, heads: DataFrame | None = None) -> DataFrame:
    """Records of single-sample files: ``file, sample, contig, pos, end_pos, id, alleles, qual, filters, gt, info, fmt``.

    ``pos`` and ``end_pos`` are 0-based and inclusive. Missing ids stay ``.``; missing
    quality and filters are null. Files without a sample column belong to the
    sample ``""``; files with several raise. Lines with fewer than 8 fields are
    left out. No records give an empty table. ``heads``: what :func:`read_headers`
    gave for these files, where the caller has it already; else their beginnings
    are read beside the one scan of the lines.
    """
    names = (heads if heads is not None else read_headers(spark, paths)).select("file", "sample")
    if isinstance(paths, str) or len(paths) <= NAMED:
        names = F.broadcast(names)  # a row a file of one call; else the join is left to Spark
    body = text_lines(spark, paths).where(~F.col("value").startswith("#")).withColumn("c", F.split("value", "\t")).where(F.size("c") >= 8)
    c = F.col("c")
    none = lambda x: F.when(x != ".", x)
    pos = (c[1].cast("int") - 1).alias("pos")
    info = parse_map(c[7])
    keys, values = F.split(F.get("c", F.lit(8)), ":"), F.split(F.get("c", F.lit(9)), ":")
    fmt = F.when(F.size("c") > 9, map_of(F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.get(values, i).alias("v"))), lambda e: e["v"].isNotNull())))
    records = body.select(
        "file", c[0].alias("contig"), pos, c[2].alias("id"),
        F.concat(F.array(c[3]), F.filter(F.split(c[4], ","), lambda a: a != ".")).alias("alleles"),
        c[5].try_cast("float").alias("qual"), F.split(none(c[6]), ";").alias("filters"),
        info.alias("info"), F.coalesce(fmt, F.expr("cast(map() as map<string,string>)")).alias("fmt"),
    )
    end = A.end_position(F.col("pos"), F.element_at("alleles", 1), F.element_at("info", "END"))
    gt = F.element_at("fmt", "GT")
    return (
        records.join(names, "file")
        .withColumn("end_pos", end)
        .withColumn("gt", A.decode_gt(gt))
        .select("file", "sample", "contig", "pos", "end_pos", "id", "alleles", "qual", "filters", "gt", "info", "fmt")
    )


def column_sample(line: str, file: str) -> str:
    """The sample a column line names; ``""`` where it has no sample column. Raises for several and for names that can't be."""
    c = line.split("\t")
    if len(c) > 10:
        raise ValueError(f"more than one sample in {file}")
    name = c[9].strip() if len(c) == 10 else ""
    if any(x in name for x in ",\t\0"):
        raise ValueError(f"no valid sample name in {file}")
    return name


def read_headers(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``file, sample, header``: header texts with the lines in their order, without the column line. A file is read up to that line only; one without it is left out."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, file in zip(pdf["path"], pdf["file"]):
                own = []
                for line in lines_of(path):
                    if line.startswith("##"):
                        own.append(line)
                    elif line.startswith("#"):
                        rows.append((file, column_sample(line, file), "\n".join(own)))
                        break
                    elif line:
                        break
            yield pd.DataFrame(rows, columns=["file", "sample", "header"])

    found = listed(spark, paths)
    return found.repartition(F.col("path")).mapInPandas(heads, "file string, sample string, header string")


def merged_header(headers: DataFrame) -> str:
    """One header text from ``sample, header`` of many samples: the first sample's lines, and of the others the declarations it lacks.

    Of several declarations of one name that of the first sample in order counts.
    What is collected is bounded by the distinct names declared.
    """
    first = headers.orderBy("sample").limit(1).collect()
    if not first:
        return ""
    own = (first[0]["header"] or "").splitlines()
    line = F.explode(F.split("header", r"\r\n|\n|\r"))
    lines = headers.select("sample", line.alias("line")).where(F.col("line").rlike("^##(INFO|FORMAT|FILTER|ALT|contig)=<"))
    keyed = lines.select("sample", "line", F.regexp_extract("line", "^##([A-Za-z]+)", 1).alias("kind"), F.regexp_extract("line", "[<,]ID=([^,>]*)", 1).alias("id"))
    found = keyed.groupBy("kind", "id").agg(F.min(F.struct("sample", "line")).alias("m")).select("kind", "id", "m.line").collect()
    have = {(m[1], m[2]) for x in own if (m := re.match(r"##(\w+)=<(?:.*?,)?ID=([^,>]*)", x))}
    return "\n".join([*own, *(r["line"] for r in sorted(found, key=lambda r: (r["kind"], r["id"])) if (r["kind"], r["id"]) not in have)])


def typed(records: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """``records`` with a typed column ``info_X`` or ``fmt_X`` per field."""
    return records.withColumns({f.column: f.value() for f in fields})
