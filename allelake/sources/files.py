"""Opening files on the executors: any file system, plain, gzip or block gzip."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.session import ship

#: Suffixes of block gzip that Spark's text reader doesn't know.
BLOCKED = (".bgz", ".bgzf")


def open_uri(uri: str):
    """(file system, path) of a URI or plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def lines_of(uri: str) -> Iterator[str]:
    """The lines of a text file, unpacked if it is gzip. Only what is asked for is read."""
    system, at = open_uri(uri)
    with system.open_input_file(at) as raw:
        packed = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        with io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if packed else raw, encoding="utf-8", errors="replace", newline=None) as text:
            for line in text:
                yield line.rstrip("\n")


def listed(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``path, file`` of the files below paths: the path to open, and the name that scans give them. Contents aren't read."""
    ship(spark)
    found = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return found.select("path", F.col("_metadata.file_path").alias("file"))


def text_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``value, file``: the lines of text files. Block gzip under its own suffixes is unpacked by Python, a file a task."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    plain, blocked = [p for p in paths if not p.endswith(BLOCKED)], [p for p in paths if p.endswith(BLOCKED)]
    parts = []
    if plain:
        parts.append(spark.read.text(plain).select("value", F.col("_metadata.file_path").alias("file")))
    if blocked:

        def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for path, file in zip(pdf["path"], pdf["file"]):
                    held = []
                    for line in lines_of(path):
                        held.append(line)
                        if len(held) == 10_000:
                            yield pd.DataFrame({"value": held, "file": file})
                            held = []
                    yield pd.DataFrame({"value": pd.Series(held, dtype=object), "file": file})

        parts.append(listed(spark, blocked).repartition(len(blocked), "path").mapInPandas(unpack, "value string, file string"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
