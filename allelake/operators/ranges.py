"""Range partitions by (entity, position), the base of ordered scans with carried state.

Every entity's positions are cut into ranges; an entity that fits one task has
one range, a large one is cut at quantiles of its positions. The cuts are
collected once (there are at most twice as many as tasks), so a row's range is a
pure function of the row and every later pass sees the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelake.session import task_count

#: The range's number within its entity.
RANGE = "__range"

#: Cuts are searched in two steps of this many.
_STEP = 256


def range_cuts(df: DataFrame, entity: Sequence[str], position: str, tasks: int | None = None, least: int = 20_000) -> DataFrame:
    """Cuts of the entities with more rows than half a task's share (and than ``least``): entity columns, ``__cuts`` (ascending longs).

    Rows with the same position are never separated.
    """
    spark = df.sparkSession
    tasks = tasks or task_count(spark)
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in entity), T.StructField("__cuts", T.ArrayType(T.LongType()))])
    share = max(least, df.count() / (2 * tasks))
    large = [r for r in df.groupBy(*entity).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > share).collect()]  # at most 2 * tasks rows
    if not large:
        return spark.createDataFrame([], schema)
    parts = {tuple(r[c] for c in entity): int(r["__n"] // share) + 1 for r in large}
    fine = max(parts.values())
    keys = spark.createDataFrame([(*k, n) for k, n in parts.items()], T.StructType([*(T.StructField(f"__e{i}", df.schema[c].dataType) for i, c in enumerate(entity)), T.StructField("__parts", T.IntegerType())]))
    on = F.lit(True)
    for i, c in enumerate(entity):
        on = on & df[c].eqNullSafe(keys[f"__e{i}"])
    quantiles = F.percentile_approx(F.col(position).cast("long"), [i / fine for i in range(1, fine)] or [0.5], 10_000)
    found = (
        df.join(F.broadcast(keys), on)
        .groupBy(*entity, "__parts")
        .agg(quantiles.alias("__q"))
        .select(*entity, F.expr(f"array_sort(array_distinct(transform(sequence(1, __parts - 1), i -> __q[cast(floor(i * {fine} / __parts) as int) - 1])))").alias("__cuts"))
    )
    return spark.createDataFrame(found.collect(), schema)


def with_range(df: DataFrame, cuts: DataFrame, entity: Sequence[str], position: str, extra: str | None = None) -> DataFrame:
    """Add ``__range``: how many cuts lie at or below the row's position (0 for entities without cuts). ``extra``: a further column of ``cuts`` to bring along."""
    right = cuts.select(*(F.col(c).alias(f"__e{i}") for i, c in enumerate(entity)), "__cuts", F.expr(f"filter(__cuts, (c, i) -> i % {_STEP} = 0)").alias("__coarse"), *([extra] if extra else []))
    on = F.lit(True)
    for i, c in enumerate(entity):
        on = on & df[c].eqNullSafe(right[f"__e{i}"])
    at = f"cast(`{position}` as bigint)"
    coarse = f"(size(filter(__coarse, c -> c <= {at})) - 1)"
    found = f"case when __cuts is null or size(__cuts) = 0 or {at} < __cuts[0] then 0 else {_STEP} * {coarse} + size(filter(slice(__cuts, {_STEP} * {coarse} + 1, {_STEP}), c -> c <= {at})) end"
    out = df.join(F.broadcast(right), on, "left")  # at most 2 * tasks rows
    return out.withColumn(RANGE, F.expr(found).cast("int")).drop("__cuts", "__coarse", *(f"__e{i}" for i in range(len(entity))))
