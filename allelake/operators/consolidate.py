"""Many small Parquet files into few well-sized ones, by copying encoded blocks.

Footers are read first; files are put together by size within their partition
and schema. A task copies the row groups of about one target size of files byte
for byte into one file and writes a new footer with moved offsets; nothing is
decoded. Each output file appears under its final name only when it
is whole, and its name depends on its inputs alone, so a retried task replaces
its own file. Row, block and byte totals are compared at the end.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelake.session import scratch_path, task_count, written
from allelake.sources import footer as P
from allelake.sources.files import open_uri

#: Bytes of a well-sized file.
TARGET = 128 << 20

#: Bytes copied at once.
_CHUNK = 8 << 20

_SCHEMA = "path string, rows long, blocks long, bytes long, inputs long, input_rows long, input_blocks long, problem string"


class _Output:
    """One file being written: blocks so far and the footer to come."""

    def __init__(self, folder: str, first: dict, name: str) -> None:
        self.folder, self.name, self.first = folder, name, first
        self.system, base = open_uri(folder)
        self.system.create_dir(base, recursive=True)
        self.temporary, self.final = posixpath.join(base, f"_{name}.{id(self):x}.tmp"), posixpath.join(base, f"{name}.parquet")
        self.sink = self.system.open_output_stream(self.temporary)
        self.sink.write(P.MAGIC)
        self.size, self.groups, self.rows, self.inputs, self.input_rows, self.input_blocks = 4, [], 0, 0, 0, 0

    def append(self, source, meta: dict) -> None:
        groups = meta[P.GROUPS][1][1] if P.GROUPS in meta else []
        for group in groups:
            lo, hi = P.span(group)
            self.groups.append(P.moved(group, self.size - lo, len(self.groups)))
            source.seek(lo)
            left = hi - lo
            while left:
                part = source.read(min(left, _CHUNK))
                if not part:
                    raise ValueError("a row group reaches beyond its file")
                self.sink.write(part)
                left -= len(part)
            self.size += hi - lo
            self.rows += group[P.GROUP_ROWS][1]
        self.inputs += 1
        self.input_rows += meta[P.ROWS][1]
        self.input_blocks += len(groups)

    def close(self) -> tuple:
        out = dict(self.first) | {P.ROWS: (P.I64, self.rows), P.GROUPS: (P.LIST, (P.STRUCT, self.groups))}
        foot = P.footer_bytes(out)
        self.sink.write(foot)
        self.sink.close()
        self.system.move(self.temporary, self.final)
        with self.system.open_input_file(self.final) as f:  # what stands there is what was meant
            back = P.read_footer(f, f.size())
        blocks = len(back[P.GROUPS][1][1])
        ok = back[P.ROWS][1] == self.rows == self.input_rows and blocks == len(self.groups) == self.input_blocks and P.schema_key(back) == P.schema_key(self.first)
        return f"{self.folder}/{self.name}.parquet", self.rows, blocks, self.size + len(foot), self.inputs, self.input_rows, self.input_blocks, None if ok else "totals or schema differ"


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, partition`` of the Parquet files below a folder (or of one file); ``partition`` is the path of its ``name=value`` folders. Contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    above = sum("=" in part for part in folder.rstrip("/").split("/"))  # those lead to the table
    named = F.filter(F.split("path", "/"), lambda p: F.contains(p, F.lit("=")) & ~p.endswith(".parquet"))
    return found.select("path", "length", F.array_join(F.slice(named, above + 1, F.greatest(F.size(named) - above, F.lit(0))), "/").alias("partition"))


_FOOTERS = "path string, length long, partition string, schema string, rows long, blocks long"


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Schema key, rows and blocks of each file, from its footer."""
    for pdf in batches:
        out = []
        for path, length, partition in pdf[["path", "length", "partition"]].itertuples(index=False, name=None):
            meta = _meta(path)
            out.append((path, length, partition, hashlib.sha256(P.schema_key(meta)).hexdigest(), meta[P.ROWS][1], len(meta[P.GROUPS][1][1]) if P.GROUPS in meta else 0))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _FOOTERS.split(", ")])


def _meta(path: str) -> dict:
    system, at = open_uri(path)
    with system.open_input_file(at) as source:
        try:
            return P.read_footer(source, source.size())
        except (ValueError, IndexError) as e:
            raise ValueError(f"{path}: {e}") from e


def planned(files: DataFrame, target: int = TARGET) -> DataFrame:
    """Files with their footers' facts and ``__bin``: in the order of partition, schema and path, about ``target`` bytes a bin."""
    spark = files.sparkSession
    if "partition" not in files.columns:
        files = files.withColumn("partition", F.lit(""))
    files = files.where(F.col("path").isNotNull()).select("path", "length", "partition").distinct()
    order = ("partition", "schema", "path")
    read = written(files.repartition(4 * task_count(spark), "path").mapInPandas(_footers, _FOOTERS), "footers")
    ranged = written(read.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("__at", 33)
    within = Window.partitionBy(part).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(part.alias("__p")).agg(F.sum("length").alias("__size"))
    before = sizes.select("__p", F.coalesce(F.sum("__size").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row per partition of the listing
    placed = ranged.withColumns({"__own": F.coalesce(F.sum("length").over(within), F.lit(0)), "__p": part}).join(F.broadcast(before), "__p")
    return placed.withColumn("__bin", F.floor((F.col("__before") + F.col("__own")) / F.lit(target)).cast("int")).drop("__p", "__before", "__own", "__at")


def consolidate(files: DataFrame, into: str, target: int = TARGET) -> DataFrame:
    """Copy the blocks of ``files`` (``path, length`` and, of partitioned tables, ``partition``) into few files below ``into`` and return what was written.

    One row per output file: ``path, rows, blocks, bytes, inputs, input_rows,
    input_blocks``. Files of different schemas or partitions never share an output;
    partitions keep their folders, so a reader gets their columns back. Files are
    put together by size within partition and schema, so outputs are about
    ``target`` bytes and, beside one for each partition and schema, not more than
    that needs. A task has one output open at a time. A path listed twice is taken
    once; files without rows add nothing; an empty listing writes nothing. Raises if
    a file is no plain Parquet file or any total differs from that of the footers.
    """
    spark = files.sparkSession
    plan = written(planned(files, target), "plan")
    number, rows, blocks, bins = plan.agg(F.count(F.lit(1)), F.sum("rows"), F.sum("blocks"), F.max("__bin")).first()
    placed = plan.repartitionById((bins or 0) + 1, F.col("__bin")).sortWithinPartitions("partition", "schema", "path")

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        output, held, done = None, None, []
        for pdf in batches:
            for path, partition, schema in pdf[["path", "partition", "schema"]].itertuples(index=False, name=None):
                meta = _meta(path)
                if output is not None and held != (partition, schema):
                    done.append(output.close())
                    output = None
                if output is None:
                    held, folder = (partition, schema), f"{into}/{partition}" if partition else into
                    output = _Output(folder, meta, "part-" + hashlib.sha256(f"{schema}{path}".encode()).hexdigest()[:32])
                system, at = open_uri(path)
                with system.open_input_file(at) as source:
                    output.append(source, meta)
        if output is not None:
            done.append(output.close())
        yield pd.DataFrame(done, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    report = placed.select("path", "partition", "schema").mapInPandas(copy, _SCHEMA).collect()  # a row per well-sized file
    wrong = [r for r in report if r["problem"]]
    found = tuple(sum(r[c] for r in report) for c in ("inputs", "rows", "blocks"))
    if wrong or found != (number, rows or 0, blocks or 0):
        raise RuntimeError(f"consolidation failed its check: {wrong[:3]}, {found} of {(number, rows, blocks)} files, rows and blocks")
    return spark.createDataFrame([tuple(r)[:-1] for r in report], _SCHEMA.rpartition(", ")[0])


def consolidated(spark: SparkSession, folder: str, target: int = TARGET) -> DataFrame:
    """The table below ``folder``, partition columns included, read from well-sized files written into the shared folder."""
    into = scratch_path(spark, "consolidated")
    report = consolidate(listed_files(spark, folder), into, target)
    return spark.read.parquet(folder) if report.isEmpty() else spark.read.option("mergeSchema", "true").parquet(into)
