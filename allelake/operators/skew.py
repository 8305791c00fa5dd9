"""Per-key results when a few keys hold most rows: fragment and replicate by load.

The load of every key is estimated from one row in ``ONE_IN``, picked by a hash.
Keys that matter for balance (at least ``light`` of one task's share; so about
``tasks / light`` of them at most, whatever the data) go to the driver, where
longest-first bin packing puts them on tasks and cuts keys above one share into
proportionate shards. All other keys are hashed. The estimate decides where rows
go, never what comes out. A row's shard is a hash of its own columns, so a
retried task sends every row to the same place again.

Rows that must stay rows (:func:`balanced_apply`, :func:`fragment_replicate_join`)
are shuffled to their planned bin by ``repartitionById``, which Spark knows as a
partitioning by key, so nothing is shuffled again. Aggregates are combined on
the map side and their partial rows go to the bin in the same shuffle: each
piece carries a token with which the hash of its grouping columns is the bin.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelake.session import task_count

#: Internal columns; a caller's columns of these names are refused.
BIN, SHARD, TOKEN = "__bin", "__shard", "__token"

#: Loads are estimated from one row in so many.
ONE_IN = 16

#: Tokens tried for a piece, as a multiple of the tasks: all but one piece in 10 million find one, and that one is hashed.
_TRIES = 16


@dataclass(frozen=True)
class LoadPlan:
    """Where the rows of each key go. ``heavy`` has one row a planned key: the keys, ``__bins`` and ``__tokens`` (one a shard). ``total`` is estimated."""

    keys: tuple[str, ...]
    tasks: int
    total: int
    heavy: DataFrame

    def shards(self) -> dict[tuple, int]:
        """Shards of each planned key; keys that are missing here have one."""
        return {tuple(r[k] for k in self.keys): len(r["__bins"]) for r in self.heavy.collect()}


def pack(loads: list[tuple[tuple, int]], tasks: int, total: int) -> dict[tuple, list[int]]:
    """Bins of each key's shards: keys above one share are cut evenly, then the longest piece goes to the emptiest bin."""
    share = max(1.0, total / tasks)
    rest = (total - sum(n for _, n in loads)) / tasks  # hashed keys load all bins alike
    heap = [(rest, b) for b in range(tasks)]
    heapq.heapify(heap)
    pieces = []
    for key, n in loads:
        shards = max(1, math.ceil(n / share))
        pieces += [(n / shards, key, s) for s in range(shards)]
    bins: dict[tuple, list[int]] = {key: [] for key, _ in loads}
    for load, key, _ in sorted(pieces, key=lambda p: (-p[0], repr(p[1]), p[2])):
        filled, b = heapq.heappop(heap)
        bins[key].append(b)
        heapq.heappush(heap, (filled + load, b))
    return bins


def plan_load(df: DataFrame, keys: Sequence[str], tasks: int | None = None, light: float = 0.05, salt: Sequence[str] | None = None, one_in: int = ONE_IN) -> LoadPlan:
    """Estimate the load of each key and plan shards and bins.

    ``salt``: the columns whose hash picks the rows that are counted (default: all
    but the keys, or the keys where there are no others); 1 for ``one_in`` counts
    all. Null is a key like any other. An empty table gives an empty plan.
    """
    spark = df.sparkSession
    tasks = tasks or task_count(spark)
    picked = [c for c in df.columns if c not in keys] if salt is None else list(salt)
    some = df.where(F.pmod(F.xxhash64(F.lit("load"), *picked), F.lit(one_in)) == 0) if picked and one_in > 1 else df
    loads = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    # One job: the few keys above a bound that the number of tasks gives, and the total beside them.
    whole = loads.agg(F.sum("__n").alias("__total"))
    rows = loads.join(F.broadcast(whole), F.col("__n") >= light * F.col("__total") / tasks).collect()  # the total: one row
    total = rows[0]["__total"] if rows else 0
    bins = pack([(tuple(r[k] for k in keys), r["__n"]) for r in rows], tasks, total)
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    schema = T.StructType([*fields, T.StructField("__bins", T.ArrayType(T.IntegerType())), T.StructField("__tokens", T.ArrayType(T.IntegerType()))])
    if not bins:
        return LoadPlan(tuple(keys), tasks, total, spark.createDataFrame([], schema))
    pieces = spark.createDataFrame([(*key, s, b) for key, bs in bins.items() for s, b in enumerate(bs)], T.StructType([*fields, T.StructField(SHARD, T.IntegerType()), T.StructField(BIN, T.IntegerType())]))
    tried = pieces.withColumn(TOKEN, F.explode(F.sequence(F.lit(1), F.lit(_TRIES * tasks))))
    hits = tried.where(F.pmod(F.hash(*keys, SHARD, TOKEN), F.lit(tasks)) == F.col(BIN)).groupBy(*keys, SHARD).agg(F.min(TOKEN).alias(TOKEN)).collect()
    token = {(tuple(r[k] for k in keys), r[SHARD]): r[TOKEN] for r in hits}
    return LoadPlan(tuple(keys), tasks, total, spark.createDataFrame([(*key, b, [token.get((key, s), 0) for s in range(len(b))]) for key, b in bins.items()], schema))


def _planned(df: DataFrame, plan: LoadPlan, *more: str) -> tuple[DataFrame, Column]:
    """The planned keys under internal names, and the condition that finds a row's."""
    right = plan.heavy.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(plan.keys)), *more)
    on = F.lit(True)
    for i, k in enumerate(plan.keys):
        on = on & df[k].eqNullSafe(right[f"__k{i}"])
    return right, on


def _home(plan: LoadPlan) -> Column:
    return F.pmod(F.xxhash64(*plan.keys), F.lit(plan.tasks)).cast("int")


def fragment(df: DataFrame, plan: LoadPlan, salt: Sequence[str] | None = None) -> DataFrame:
    """Add ``__bin``, ``__shard`` and ``__token`` to every row.

    ``salt``: the columns whose hash picks the shard (default: all). Where many
    rows are equal in all of them, name a column that is unique.
    """
    if {BIN, SHARD, TOKEN, "__bins", "__tokens"} & set(df.columns):
        raise ValueError("columns __bin, __shard, __token, __bins and __tokens are reserved")
    right, on = _planned(df, plan, "__bins", "__tokens")
    picked = F.pmod(F.xxhash64(*(salt or df.columns)), F.size("__bins")).cast("int")
    joined = df.join(F.broadcast(right), on, "left")  # at most about tasks / light rows
    alone = F.col("__bins").isNull()
    return joined.withColumns({
        SHARD: F.when(alone, 0).otherwise(picked), BIN: F.when(alone, _home(plan)).otherwise(F.get("__bins", picked)), TOKEN: F.when(alone, 0).otherwise(F.get("__tokens", picked)),
    }).drop("__bins", "__tokens", *(c for c in right.columns if c.startswith("__k")))


def balanced_aggregate(
    df: DataFrame, keys: Sequence[str], partial: Sequence[Column], final: Sequence[Column], plan: LoadPlan | None = None, salt: Sequence[str] | None = None
) -> DataFrame:
    """Per-key aggregates: ``partial`` per (key, shard) in its planned bin, ``final`` over the shards.

    Both steps combine on the map side, so only partial rows are shuffled. Nulls
    in key columns form a group; an empty table gives no rows.
    """
    plan = plan or plan_load(df, keys, salt=salt)
    parts = fragment(df, plan, salt).groupBy(*keys, SHARD, TOKEN).agg(*partial)  # the hash of these columns is the bin
    return parts.groupBy(*keys).agg(*final)


def balanced_apply(df: DataFrame, keys: Sequence[str], shard_fn, shard_schema: str, merge_fn, schema: str, plan: LoadPlan | None = None, salt: Sequence[str] | None = None) -> DataFrame:
    """Per-key results of Python functions: ``shard_fn`` on the rows of one (key, shard), ``merge_fn`` on one key's shard results.

    ``shard_schema`` must hold the keys. Rows are moved to their planned bin in one
    shuffle, so the tasks' loads are even; a group handed to ``shard_fn`` holds at
    most about one task's share.
    """
    plan = plan or plan_load(df, keys, salt=salt)
    placed = fragment(df, plan, salt).drop(TOKEN).repartitionById(plan.tasks, BIN)
    parts = placed.groupBy(*keys, SHARD, BIN).applyInPandas(lambda pdf: shard_fn(pdf.drop(columns=[SHARD, BIN])), shard_schema)
    return parts.groupBy(*keys).applyInPandas(merge_fn, schema)


def fragment_replicate_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", plan: LoadPlan | None = None, salt: Sequence[str] | None = None) -> DataFrame:
    """Join a skewed ``left`` with ``right``: heavy keys of ``left`` are sharded, the rows of ``right`` are copied to the bins that hold those shards only.

    ``how``: inner, left, leftsemi or leftanti. A null key matches nothing, as in
    SQL. Columns of ``right`` whose names clash with ``left`` get the suffix ``_right``.
    Both sides are shuffled once, by bin; the join shuffles nothing more.
    """
    if how not in ("inner", "left", "leftsemi", "leftanti"):
        raise ValueError(f"how={how!r}: rows of a replicated side can't be preserved")
    plan = plan or plan_load(left, keys, salt=salt)
    taken = set(left.columns) | set(right.columns)
    names = {}
    for c in right.columns:
        if c not in keys:
            name = c if c not in left.columns else f"{c}_right"
            while name != c and name in taken:
                name += "_"
            taken.add(name)
            names[c] = name
    cut, on = _planned(right, plan, "__bins")
    copies = right.join(F.broadcast(cut), on, "left")  # at most about tasks / light rows
    places = F.coalesce(F.transform("__bins", lambda b, i: F.struct(i.alias(SHARD), b.alias(BIN))), F.array(F.struct(F.lit(0).alias(SHARD), _home(plan).alias(BIN))))
    copies = copies.select(*(right[k] for k in keys), *(right[c].alias(n) for c, n in names.items()), F.inline(places))
    placed = [df.repartitionById(plan.tasks, BIN) for df in (fragment(left, plan, salt).drop(TOKEN), copies)]
    return placed[0].join(placed[1], [*keys, SHARD, BIN], how).drop(SHARD, BIN)
