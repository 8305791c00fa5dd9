"""Percentiles per group with bounded error, in a form that partitions and days combine from.

Every partition builds relative-rank sketches of its own rows (memory bounded by
a flush); sketches, not rows, are shuffled and merged, first those of ``FAN_IN``
partitions each, then the rest, so merging a group is spread over tasks. Where a decision needs the
exact value, :func:`exact_percentiles` counts within the bracket a sketch gives.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from allelake.llm.sketch import SECTION, RankSketch
from allelake.session import written

#: Values a partition holds in sketches before it hands them on, and values it gathers before they go into sketches.
FLUSH, LOOSE = 4_000_000, 500_000

#: Sketches merged by one task in the first merging step.
FAN_IN = 64


def sketches(df: DataFrame, group: Sequence[str], value: str, section: int = SECTION) -> DataFrame:
    """One row per group: the group's columns, ``n`` (long, exact), ``sketch`` (binary).

    Null and NaN are no values; infinities are. Groups without values have no row.
    A null in a group column is a value of it. An empty table gives no rows.
    """
    group = list(group)
    # Keys travel beside the sketches; the value column gets a name no key can have.
    rows = df.select(*group, F.col(value).cast("double").alias("__value")).where("__value is not null and not isnan(__value)")
    schema = _schema(rows, group, "__part")
    arrow = to_arrow_schema(schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() // FAN_IN
        held: dict[tuple, list[np.ndarray]] = {}  # plain values up to a buffer's size, then sketches
        made: dict[tuple, RankSketch] = {}
        loose = size = 0

        def fold() -> None:
            nonlocal loose
            for key, parts in held.items():
                made.setdefault(key, RankSketch(section)).add(np.concatenate(parts))
            held.clear()
            loose = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = _batch([(*k, part, s.n, s.to_bytes()) for k, s in made.items()], arrow)
            made.clear()
            size = 0
            return out

        for batch in batches:
            values = batch.column(len(group)).to_numpy(zero_copy_only=False)
            for key, at in _grouped(batch, len(group)):
                held.setdefault(key, []).append(values[at])
            loose += len(values)
            size += len(values)
            if loose > LOOSE:
                fold()
                if size > FLUSH and sum(sum(map(len, s.levels)) for s in made.values()) > FLUSH:
                    yield flush()
        fold()
        if made:
            yield flush()

    parts = rows.mapInArrow(build, schema)
    return _merged(_merged(parts, [*group, "__part"]), group)


def _schema(df: DataFrame, group: Sequence[str], *more: str) -> T.StructType:
    kinds = {"__part": T.IntegerType()}
    return T.StructType([*(T.StructField(c, kinds.get(c) or df.schema[c].dataType) for c in [*group, *more]), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _grouped(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each key (a tuple of the first ``keys`` columns' values) of a batch and the places of its rows, in order."""
    codes, names = np.zeros(batch.num_rows, np.int64), []
    for i in range(keys):
        coded = batch.column(i).dictionary_encode()
        own = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
        names.append([*coded.dictionary.to_pylist(), None])
        codes = codes * len(names[-1]) + own
    order = np.argsort(codes, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        if len(at):
            code, key = int(codes[at[0]]), []
            for own in reversed(names):
                code, place = divmod(code, len(own))
                key.append(own[place])
            yield tuple(reversed(key)), at


def _merged(parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per group from rows of ``group, n, sketch``. Rows come sorted by group and are merged as they pass, so a task holds one sketch however many a group has."""
    group = list(group)
    schema = _schema(parts, group)
    arrow = to_arrow_schema(schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, whole, done = None, 0, None, []
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(len(group))))
            for own, m, blob in zip(keys, batch.column(len(group)).to_pylist(), batch.column(len(group) + 1)):
                if whole is not None and own == key:
                    whole = whole if isinstance(whole, RankSketch) else RankSketch.from_bytes(whole)
                    whole.merge(RankSketch.from_bytes(blob.as_py()))
                    n += m
                    continue
                if whole is not None:
                    done.append((*key, n, whole.to_bytes() if isinstance(whole, RankSketch) else whole))
                key, n, whole = own, m, blob.as_py()  # read only if another follows
                if len(done) >= 256:
                    yield _batch(done, arrow)
                    done = []
        if whole is not None:
            done.append((*key, n, whole.to_bytes() if isinstance(whole, RankSketch) else whole))
        yield _batch(done, arrow)

    placed = parts.select(*group, "n", "sketch").repartition(*group).sortWithinPartitions(*group)
    return placed.mapInArrow(merge, schema)


def combine(sketched: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups (say, over all days) from those of finer ones. Same columns as :func:`sketches`."""
    return _merged(sketched, group)


def quantiles(sketched: DataFrame, percents: Sequence[float], deviations: float = 4.0) -> DataFrame:
    """Rows ``pct, lower, estimate, upper`` for each sketch: bounds at so many standard deviations; equal where the sketch is exact."""
    kept = [f for f in sketched.schema.fields if f.name != "sketch"]
    schema = T.StructType([*kept, T.StructField("pct", T.DoubleType()), *(T.StructField(c, T.DoubleType()) for c in ("lower", "estimate", "upper"))])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*keys, float(p), *q) for *keys, blob in pdf[[*(f.name for f in kept), "sketch"]].itertuples(index=False, name=None) for p, q in zip(percents, RankSketch.from_bytes(blob).quantiles(percents, deviations))]
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields]).astype({"n": "int64"} if "n" in pdf else {})

    return sketched.mapInPandas(read, schema)


def exact_percentiles(df: DataFrame, group: Sequence[str], value: str, targets: DataFrame, small: int = 50_000) -> DataFrame:
    """The exact percentile of each target: ``targets`` with ``exact`` (double).

    ``targets`` has the group's columns, ``pct``, ``n`` (values of the group) and the
    bracket ``lower``/``upper``; a bracket that turns out not to hold the
    percentile is dropped and that target counted over all values. Only values
    inside the bracket are sorted, as counts of equal values. Targets are
    broadcast up to ``small`` rows and shuffled beyond.
    """
    group = list(group)
    targets = written(targets.select(*group, "pct", "n", "lower", "upper").distinct(), "targets")
    rows = df.select(*(F.col(c).alias(f"g{i}") for i, c in enumerate(group)), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    ids = [f"g{i}" for i in range(len(group))]

    def count(wanted: DataFrame) -> DataFrame:
        named = wanted.select(*(F.col(c).alias(f"t{i}") for i, c in enumerate(group)), "pct", "n", "lower", "upper")
        on = F.col("v") <= F.col("upper")
        for i in range(len(group)):
            on = on & F.col(f"g{i}").eqNullSafe(F.col(f"t{i}"))
        counted = rows.join(F.broadcast(named) if few else named, on).groupBy(*(f"t{i}" for i in range(len(group))), "pct", "n", "lower", "upper", F.when(F.col("v") >= F.col("lower"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
        below = Window.partitionBy(*(f"t{i}" for i in range(len(group))), "pct").orderBy(F.col("v").asc_nulls_first())
        ranked = counted.withColumn("upto", F.sum("c").over(below)).withColumn("need", F.ceil(F.col("pct") * F.col("n") / 100))
        hit = ranked.where("v is not null and upto >= need and upto - c < need")
        return hit.select(*(F.col(f"t{i}").alias(c) for i, c in enumerate(group)), "pct", F.col("v").alias("exact"))

    few = targets.limit(small + 1).count() <= small
    found = written(count(targets), "exact")
    on = F.lit(True)
    for c in [*group, "pct"]:
        on = on & targets[c].eqNullSafe(found[c])
    missed = targets.join(found, on, "left_anti")
    if missed.limit(1).count():
        again = missed.withColumns({"lower": F.lit(float("-inf")), "upper": F.lit(float("inf"))})
        found = found.unionByName(written(count(again), "exact"))
        on = F.lit(True)
        for c in [*group, "pct"]:
            on = on & targets[c].eqNullSafe(found[c])
    return targets.join(found.select(*(F.col(c).alias(f"f{i}") for i, c in enumerate([*group, "pct"])), "exact"), _on(targets, [*group, "pct"])).drop(*(f"f{i}" for i in range(len(group) + 1)))


def _on(targets: DataFrame, cols: Sequence[str]):
    on = F.lit(True)
    for i, c in enumerate(cols):
        on = on & targets[c].eqNullSafe(F.col(f"f{i}"))
    return on
