"""Items of varying size into containers of fixed capacity.

Method: bounded-space online packing. Each partition keeps ``OPEN`` open windows; an
item goes where it leaves least room; if it fits nowhere the fullest window is
emitted and a new one opened. What is open at the end is merged in a second
step, over many partitions together, without taking windows apart. Items are
never split here; those above the capacity must be split before.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelake.llm import tokens as K
from allelake.llm.splitting import LIMIT, split
from allelake.session import written

#: Open windows of a partition; partitions whose leftovers one task merges.
OPEN, MERGED = 64, 256


class Windows:
    """The open windows of one partition, numbered in order of opening."""

    def __init__(self, capacity: int, open_: int) -> None:
        self.capacity, self.open = capacity, open_
        self.rooms: list[tuple[int, int]] = []
        self.number = 0

    def place(self, size: int) -> int:
        """The window an item goes into."""
        if not 0 <= size <= self.capacity:
            raise ValueError(f"an item of {size} can't stand in a container of {self.capacity}")
        i = bisect_left(self.rooms, (size, -1))
        if i < len(self.rooms):
            room, w = self.rooms.pop(i)
        else:
            if len(self.rooms) >= self.open:
                self.rooms.pop(0)  # the fullest is emitted
            room, w = self.capacity, self.number
            self.number += 1
        if room > size:
            insort(self.rooms, (room - size, w))
        return w

    def left(self) -> list[tuple[int, int]]:
        """(window, fill) of those still open."""
        return sorted((w, self.capacity - room) for room, w in self.rooms)


def merge_plan(fills: list[int], capacity: int) -> list[int]:
    """For each partly filled window the container it goes into (an index into the list): longest first, best fit, nothing taken apart."""
    into = [0] * len(fills)
    rooms: list[tuple[int, int]] = []
    for i in sorted(range(len(fills)), key=lambda i: (-fills[i], i)):
        at = bisect_left(rooms, (fills[i], -1))
        room, c = rooms.pop(at) if at < len(rooms) else (capacity, i)
        into[i] = c
        insort(rooms, (room - fills[i], c))
    return into


def pack(items: DataFrame, size: str, capacity: int, open_: int = OPEN) -> DataFrame:
    """``items`` with ``container_id``: the items of one container have together at most ``capacity``.

    Every row comes out once, repeated rows as often as they stand. Sizes must be
    whole numbers from 0 to the capacity; a null counts as 0. Rows stay in their
    partitions for the first step, so nothing is shuffled but the leftovers.
    Empty tables give no rows; a column named ``container_id`` or ``__open`` raises.
    """
    if {"container_id", "__open"} & set(items.columns):
        raise ValueError("columns container_id and __open are made here")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in items.schema.fields), T.StructField("container_id", T.LongType()), T.StructField("__open", T.LongType())])
    arrow = to_arrow_schema(schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        state = Windows(capacity, open_)
        for batch in batches:
            placed = [base + state.place(s or 0) for s in batch.column(size).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(placed, pa.int64()), pa.nulls(len(placed), pa.int64())], schema=arrow)
        left = state.left()
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(left), f.type) for f in list(arrow)[:-2]), pa.array([base + w for w, _ in left], pa.int64()), pa.array([fill for _, fill in left], pa.int64())], schema=arrow)

    placed = written(items.mapInArrow(first, schema), "packed")
    left = placed.where("__open is not null").select("container_id", F.col("__open").alias("fill"), F.shiftright("container_id", 32).alias("part"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("container_id")
        ids = pdf["container_id"].tolist()
        return pd.DataFrame({"old": ids, "new": [ids[c] for c in merge_plan(pdf["fill"].tolist(), capacity)]})

    # At most OPEN windows a partition: a task merges OPEN * MERGED of them.
    moved = left.groupBy(F.floor(F.col("part") / MERGED).alias("task")).applyInPandas(merge, "old long, new long").where("old <> new")
    rows = placed.where("__open is null").drop("__open")
    return rows.join(moved, rows["container_id"] == moved["old"], "left").withColumn("container_id", F.coalesce("new", "container_id")).drop("old", "new")


def sized_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = LIMIT, path: str | None = None) -> DataFrame:
    """One row per text or, of a text above the capacity, per piece: ``doc_id, piece_no, first_byte, end_byte, n_tokens``.

    Pieces have no overlap. Null and empty texts have one row of 0 tokens, so
    every row of the table comes out.
    """
    docs = documents.select(F.col(doc_id), F.col(text))
    schema = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType)])
    for name, kind in (("piece_no", T.IntegerType()), ("first_byte", T.LongType()), ("end_byte", T.LongType()), ("n_tokens", T.IntegerType())):
        schema.add(name, kind)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (key, i, *piece)
                for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for i, piece in enumerate(split(t, capacity, 0, path) if t else [(0, 0, 0)])
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, arrow)], schema=arrow)

    return docs.mapInArrow(sizes, schema)


def pack_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = LIMIT, path: str | None = None) -> DataFrame:
    """Texts in containers of ``capacity`` tokens: :func:`sized_texts` with ``container_id``."""
    return pack(sized_texts(documents, doc_id, text, capacity, path), "n_tokens", capacity)
