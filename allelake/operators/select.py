"""Which records a read gets: samples, time, limits and partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelake.session import written
from allelake.sources.listing import numbered


def with_samples(records: DataFrame, samples: Sequence[str] | DataFrame, check_against: DataFrame | None = None) -> DataFrame:
    """Records of the given samples. ``check_against`` (a table with ``sample``): raise if any name isn't in it.

    A list becomes a predicate the scan sees; a table is semi-joined, whatever its size.
    """
    if isinstance(samples, DataFrame):
        if check_against is not None:
            unknown = samples.join(check_against, "sample", "left_anti").limit(5).collect()
            if unknown:
                raise ValueError(f"samples not in the dataset: {sorted(r['sample'] for r in unknown)}")
        return records.join(samples.select("sample").distinct(), "sample", "left_semi")
    names = list(dict.fromkeys(samples))
    if check_against is not None:
        known = {r["sample"] for r in check_against.where(F.col("sample").isin(names)).select("sample").distinct().collect()}
        if unknown := sorted(set(names) - known):
            raise ValueError(f"samples not in the dataset: {unknown[:5]}")
    return records.where(F.col("sample").isin(names))


def as_of(records: DataFrame, start_ms: int | None = None, end_ms: int | None = None, column: str = "ingest_ts") -> DataFrame:
    """Records ingested from ``start_ms`` to ``end_ms`` (milliseconds, both included). A start after the end gives none."""
    kind = records.schema[column].dataType.simpleString()
    kind = kind if kind.startswith("timestamp") else "timestamp"
    at = F.col(column) if kind == records.schema[column].dataType.simpleString() else F.col(column).cast(kind)
    when = lambda ms: F.timestamp_millis(F.lit(int(ms))).cast(kind)  # noqa: E731  a constant of the column's own type, so the comparison reaches the scan
    out = records
    if start_ms is not None:
        out = out.where(at >= when(start_ms))
    return out.where(at < when(end_ms + 1)) if end_ms is not None else out


def limited(records: DataFrame, limit: int, order: Sequence[str] = ()) -> DataFrame:
    """The first ``limit`` rows; in an order if one is given."""
    return (records.orderBy(*order) if order else records).limit(limit)


def sample_partition(samples: DataFrame, index: int, count: int) -> DataFrame:
    """Part ``index`` of ``count`` of the distinct samples in name order: contiguous, sizes differ by at most one, larger first.

    Raises for an index out of range and for more parts than samples.
    """
    names = samples.select("sample").where("sample is not null").distinct()
    _check(index, count)
    if count > names.count():
        raise ValueError(f"{count} partitions of fewer samples")
    return _part(names, ["sample"], index, count)


def _part(rows: DataFrame, order: Sequence[str], index: int, count: int) -> DataFrame:
    """Part ``index`` of ``count`` of the rows in order, by a range sort and the rows' numbers; the first parts have the rows that are over."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = numbered(written(ranged, "order"), "__at")
    share, over = divmod(placed.count(), count)
    first = index * share + min(index, over)
    return placed.where((F.col("__nth") >= first) & (F.col("__nth") < first + share + (index < over))).select(*rows.columns)


def region_partition(regions: DataFrame, index: int, count: int) -> DataFrame:
    """Part ``index`` of ``count`` of the regions in (contig, lo, hi) order. With more parts than regions the rest is empty."""
    _check(index, count)
    return _part(regions, ["contig", "lo", "hi", "line"], index, count)


def _check(index: int, count: int) -> None:
    if count < 1 or not 0 <= index < count:
        raise ValueError(f"no partition {index} of {count}")
