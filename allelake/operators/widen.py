"""Entity-attribute-value rows into one wide, typed row per entity.

Method: rows are partitioned by attribute into typed narrow tables (one folder
each, one row an entity), bucketed by entity as they are written; so they are
co-partitioned once, and the outer joins of the balanced tree shuffle nothing.
The tree's leaves join narrow tables to the spine of all entities, bucketed
alike: such joins keep the partitioning by entity up to the root, which chained
full outer joins wouldn't.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.functions.decimals import is_decimal, is_whole, one_spelling
from allelake.session import scratch_path, task_count

#: Narrow tables a leaf of the tree joins.
LEAF = 4

#: Spark type of one value; lists have arrays of them.
TYPES = {"Integer": "bigint", "Float": "double", "String": "string", "Flag": "boolean"}


@dataclass(frozen=True)
class Attribute:
    """A column of the wide table: ``blob`` and ``name`` as declared, ``vtype`` one of ``TYPES``, ``many``: a comma list."""

    blob: str
    name: str
    vtype: str
    many: bool

    @property
    def column(self) -> str:
        return f"{self.blob}_{self.name}"

    @property
    def spark_type(self) -> str:
        return f"array<{TYPES[self.vtype]}>" if self.many else TYPES[self.vtype]


def attributes(field_types: DataFrame, most: int = 5_000) -> list[Attribute]:
    """The declared attributes, in order. They become columns, so they must be few: more than ``most`` raise."""
    rows = field_types.select("blob_name", "attr", "vtype", "num").where("blob_name is not null and attr is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} attributes can't be columns; typed_cells gives them as rows, however many")
    return sorted((Attribute(r["blob_name"], r["attr"], r["vtype"] if r["vtype"] in TYPES else "String", r["num"] not in ("0", "1")) for r in rows), key=lambda a: (a.blob, a.name))


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def _typable(c: Column, kind: Column) -> Column:
    return (
        F.when(kind == "Integer", is_whole(c))
        .when(kind == "Float", is_decimal(c))
        .when(kind == "Flag", c.isin("0", "1"))
        .otherwise(F.lit(True))
    )


def typed_cells(cells: DataFrame, attrs: Sequence[Attribute], entity: str) -> DataFrame:
    """One row per (entity, attribute): ``picked`` (the latest typable text), ``conflict``, ``untypable``.

    An attribute is found under any case, with blanks around and with its
    blob's name and ``_`` in front. Null, blank and ``.`` are no values; in a
    list such elements are missing ones. Unknown attributes are left out.
    """
    spark = cells.sparkSession
    known = spark.createDataFrame([(a.blob, a.name, a.name.upper(), a.vtype, a.many, a.column) for a in attrs], "blob_name string, name string, spelled string, kind string, many boolean, col string")
    raw = F.upper(_trim(F.col("attr")))
    front = F.concat(F.upper("blob_name"), F.lit("_"))
    bare = F.when(raw.startswith(front), _trim(F.substr(raw, F.length(front) + 1)))
    cells = cells.select(
        F.col(entity).alias("entity"), "blob_name", F.col("cell_id").alias("cell_id"), F.col("loaded_at").alias("loaded_at"), _trim(F.col("cell_value")).alias("v"),
        F.inline(F.filter(F.array(F.struct(raw.alias("spelled"), F.lit(True).alias("exact")), F.struct(bare.alias("spelled"), F.lit(False).alias("exact"))), lambda s: s["spelled"].isNotNull())),
    ).where("entity is not null and v is not null and v not in ('', '.')")
    found = cells.join(F.broadcast(known), ["blob_name", "spelled"])  # a row per declared attribute: at most what attributes() lets pass
    elements = F.when(F.col("many"), F.split("v", ",")).otherwise(F.array("v"))
    found = found.withColumn("x", F.transform(elements, lambda e: F.when(_trim(e).isin("", "."), None).otherwise(_trim(e))))
    found = found.where(F.exists("x", lambda e: e.isNotNull()))
    found = found.withColumn("ok", F.forall("x", lambda e: e.isNull() | F.coalesce(_typable(e, F.col("kind")), F.lit(False))))
    spelled = F.transform("x", lambda e: F.when(F.col("kind").isin("Integer", "Float"), one_spelling(e)).otherwise(e))
    found = found.withColumn("same", F.when(F.col("ok"), F.array_join(spelled, ",", ".")))
    text = F.when(F.col("ok"), F.array_join(F.transform("x", lambda e: F.when(F.col("kind").isin("Integer", "Float"), F.regexp_replace(e, r"^\+", "")).otherwise(e)), ",", "."))
    # Constant-size state per (entity, attribute), combined on the map side: repeated cells cost nothing.
    return found.groupBy("entity", "blob_name", "name", "col").agg(
        F.max(F.when(F.col("ok"), F.struct("exact", "loaded_at", "cell_id", text.alias("t")))).alias("p"),
        (F.min("same") != F.max("same")).alias("conflict"),
        F.max(~F.col("ok")).alias("untypable"),
    ).select("entity", "col", F.col("p.t").alias("picked"), F.coalesce("conflict", F.lit(False)).alias("conflict"), "untypable")


def _value(a: Attribute) -> Column:
    text = F.col("picked")

    def one(c: Column) -> Column:
        if a.vtype == "Integer":  # a double only where the notation isn't plain, so all 64 bits stay
            return F.coalesce(c.try_cast("bigint"), c.try_cast("decimal(38,0)").try_cast("bigint"), c.try_cast("double").try_cast("bigint"))
        return (c == "1") if a.vtype == "Flag" else c.cast(a.spark_type.replace("array<", "").rstrip(">"))

    if not a.many:
        return one(text)
    return F.transform(F.split(text, ","), lambda e: one(F.when(e != ".", e)))


def _bucketed(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written into the shared folder in buckets of ``entity``, shuffled once, with a folder per value of ``by``; read back as what it is."""
    spark, n = df.sparkSession, task_count(df.sparkSession)
    table_name, path = f"allelake_{name}_{uuid.uuid4().hex}", scratch_path(spark, name)
    writer = df.repartition(n, "entity").write.format("parquet").option("path", path).option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).bucketBy(n, "entity").saveAsTable(table_name)
    atexit.register(_drop, spark, table_name)
    return spark.table(table_name)


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"drop table if exists {name}")
    except Exception:  # the session may be gone already
        pass


def narrow_tables(cells: DataFrame, attrs: Sequence[Attribute], entity: str) -> dict[str, DataFrame]:
    """A typed narrow table per attribute, by column name: ``entity, value, conflict, untypable``; all in the same buckets of ``entity``."""
    there = _bucketed(typed_cells(cells, attrs, entity), "narrow", "col")
    return {a.column: there.where(F.col("col") == a.column).select("entity", _value(a).alias("value"), "conflict", "untypable") for a in attrs}


def widen(cells: DataFrame, field_types: DataFrame, entity: str = "row_id", issues: bool = False) -> DataFrame:
    """One row per entity of ``cells`` with a typed column ``<blob>_<attr>`` per attribute of ``field_types``.

    Where typable values contradict each other the latest (``loaded_at``, then
    ``cell_id``) is taken, cells with the attribute's plain name before others;
    whole numbers beyond 64 bits are null. With ``issues`` each attribute has
    ``<column>__conflict`` and ``<column>__untypable`` beside it. Cells of
    undeclared attributes and with a null entity are left out; entities whose
    cells hold no value have a row of nulls. Empty tables give no rows.
    """
    attrs = attributes(field_types)
    spine = _bucketed(cells.select(F.col(entity).alias("entity")).where("entity is not null").distinct(), "spine")
    narrow = narrow_tables(cells, attrs, entity)

    def leaf(group: Sequence[Attribute]) -> DataFrame:
        out = spine
        for a in group:
            named = narrow[a.column].select("entity", F.col("value").alias(a.column), *([F.col(x).alias(f"{a.column}__{x}") for x in ("conflict", "untypable")] if issues else []))
            out = out.join(named, "entity", "left")
        return out

    nodes = [leaf(attrs[i : i + LEAF]) for i in range(0, len(attrs), LEAF)] or [spine]
    while len(nodes) > 1:  # every node has all entities, so inner joins lose none
        nodes = [nodes[i].join(nodes[i + 1], "entity") if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0].withColumnRenamed("entity", entity)
