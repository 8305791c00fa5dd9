"""Genomic regions: parsing, coalescing and region tables."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "contig string, lo int, hi int, line int"


class Region(NamedTuple):
    """Positions ``start`` to ``end`` of a contig, 1-based, both included."""

    contig: str
    start: int
    end: int

    @classmethod
    def parse(cls, text: str) -> Region:
        """``contig:start-end``; commas in numbers are dropped. Raises ValueError with the cause."""
        # The texts of the errors, which callers compare.
        contig, colon, interval = str(text).rpartition(":")
        ends = interval.replace(",", "").split("-")
        if not colon or len(ends) != 2 or not all(e.strip().isdigit() for e in ends) or ":" in contig:
            raise ValueError('"region" parameter must have format "<contig>:<start>-<end>"')
        start, end = int(ends[0]), int(ends[1])
        if not contig:
            raise ValueError("Region contig cannot be empty")
        if start <= 0:
            raise ValueError("Regions must be 1-based")
        if end < start:
            raise ValueError(f'"{interval}" is not a valid region interval')
        return cls(contig, start, end)

    def __str__(self) -> str:
        return f"{self.contig}:{self.start}-{self.end}"


def coalesce(regions: Iterable[str | Region]) -> list[Region]:
    """Sorted regions, overlapping and adjoining ones joined. For lists a driver holds; for tables use ``periods_and_gaps``."""
    out: list[Region] = []
    for r in sorted(r if isinstance(r, Region) else Region.parse(r) for r in regions):
        if out and out[-1].contig == r.contig and r.start <= out[-1].end + 1:
            out[-1] = out[-1]._replace(end=max(out[-1].end, r.end))
        else:
            out.append(r)
    return out


def region_table(spark: SparkSession, regions: Iterable[str | Region]) -> DataFrame:
    """Regions as a table with 0-based inclusive ``lo`` and ``hi`` and the region's place in the list as ``line``."""
    parsed = [r if isinstance(r, Region) else Region.parse(r) for r in regions]
    return spark.createDataFrame([(r.contig, r.start - 1, r.end - 1, i) for i, r in enumerate(parsed)], SCHEMA)


def coalesced_table(regions: DataFrame) -> DataFrame:
    """A region table of any size with overlapping and adjoining regions joined; ``line`` is null."""
    from allelake.operators.intervals import periods_and_gaps

    spans = periods_and_gaps(regions, ["contig"], "lo", "hi").where("span_kind = 'period'")
    return spans.select("contig", F.col("first_pos").cast("int").alias("lo"), F.col("last_pos").cast("int").alias("hi"), F.lit(None).cast("int").alias("line"))
