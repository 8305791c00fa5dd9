"""Region files, sample lists and input lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelake.sources.files import text_lines

#: Lines that hold a region.
_REGION = r"not value rlike '^([ \t]*$|#|track|browser)'"


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """A BED file (plain, ``.gz``, ``.bgz`` or ``.bgzf``) as regions ``contig, lo, hi, line``: 0-based inclusive, lines numbered from 0.

    Headers (``track``, ``browser``, ``#``) and empty lines have no number. Raises for
    other suffixes. Lines with fewer than three fields, or whose end isn't behind
    their start, are left out, but numbered.
    """
    if not path.endswith((".bed", ".bed.gz", ".bed.bgz", ".bed.bgzf")):
        raise ValueError(f"{path} is no BED file (.bed, .bed.gz, .bed.bgz, .bed.bgzf)")
    lines = text_lines(spark, path).where(_REGION).withColumn("__at", F.monotonically_increasing_id())
    return number_lines(lines.select("__at", F.split("value", r"\t| +").alias("c"))).select("contig", "lo", "hi", "line")


def numbered(rows: DataFrame, at: str) -> DataFrame:
    """``__nth``: the place of each row in the order of ``at`` (of ``monotonically_increasing_id``: partition, then place), from 0, without one task having all."""
    part = F.shiftright(at, 33)
    parts = rows.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = parts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row per partition
    placed = rows.withColumn("__p", part).join(F.broadcast(before), "__p")
    return placed.withColumn("__nth", F.col("__before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__before")


def number_lines(rows: DataFrame) -> DataFrame:
    """Regions with line numbers from split lines ``c`` in the order of ``__at``. Blank and header lines must be filtered before ``__at`` is made, so places have no holes."""
    return _regions(numbered(rows, "__at"), F.col("__nth").cast("int"))


def _regions(rows: DataFrame, line) -> DataFrame:
    c = lambda i: F.get("c", F.lit(i))
    return rows.select(c(0).alias("contig"), c(1).try_cast("int").alias("lo"), (c(2).try_cast("int") - 1).alias("hi"), line.alias("line")).where("hi >= lo")


def bed_table(regions: DataFrame, contig: str = "contig", start: str = "start", end: str = "end") -> DataFrame:
    """A table with other column names (0-based start, half-open end) as regions; ``line`` follows (contig, start, end)."""
    named = regions.select(F.col(contig).alias("contig"), F.col(start).cast("int").alias("lo"), (F.col(end) - 1).cast("int").alias("hi"))  # a region list
    return named.withColumn("line", (F.row_number().over(Window.partitionBy("contig").orderBy("lo", "hi")) - 1).cast("int"))


def parse_bed_bytes(spark: SparkSession, files: DataFrame, content: str = "content") -> DataFrame:
    """Regions from BED files held as binary values, such as ``binaryFile`` reads."""
    lines = files.select(F.posexplode(F.split(F.col(content).cast("string"), r"\r?\n")).alias("line", "value")).where(_REGION)
    return _regions(lines.select("line", F.split("value", r"\t| +").alias("c")), F.col("line"))


class BedFile:
    """Regions by contig: how many contigs, how many regions of one, and the i-th region."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.regions = read_bed(spark, path)

    def contigs(self) -> DataFrame:
        return self.regions.groupBy("contig").agg(F.count(F.lit(1)).alias("n_regions"), F.min("line").alias("first_line")).orderBy("first_line")

    def contig_count(self) -> int:
        return self.regions.select("contig").distinct().count()

    def region_count(self, contig: str | None = None) -> int:
        return (self.regions if contig is None else self.regions.where(F.col("contig") == contig)).count()

    def region(self, contig: str, i: int) -> tuple[str, int, int]:
        """The i-th region of a contig (from 0) as contig, 0-based start and half-open end."""
        rows = self.regions.where(F.col("contig") == contig).orderBy("line").offset(i).limit(1).collect()
        if not rows:
            raise IndexError(f"{contig} has no region {i}")
        return rows[0]["contig"], rows[0]["lo"], rows[0]["hi"] + 1


def read_sample_uris(spark: SparkSession, path: str) -> DataFrame:
    """``uri, index_uri`` from a file of lines ``uri[<tab>index]``; empty lines are left out."""
    c = F.split("value", "\t")
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim(c[0]).alias("uri"), F.trim(F.get(c, F.lit(1))).alias("index_uri"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """``sample`` from a file with a name per line; blanks around and empty lines don't count."""
    return spark.read.text(path).select(F.trim("value").alias("sample")).where("sample <> ''").distinct()
