"""Incremental ingest and running aggregates with Structured Streaming."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from allelake.dataset import Dataset
from allelake.operators import stats

#: Files that streams have ingested, a row each, written when their batch is complete.
TAKEN = "path string, modificationTime timestamp, batch string"


def watch_files(spark: SparkSession, folder: str, dataset: str, checkpoint: str, files_per_batch: int = 1_000) -> StreamingQuery:
    """Ingest variant files as they appear below ``folder``; ends when all there are have been taken.

    Text (``*.vcf*``) and binary (``*.bcf``) files are taken; any number may be of one
    sample and contig. The checkpoint remembers which files were ingested. A batch that
    is tried again after a failure writes only the tables it hadn't. The dataset's table
    ``taken`` keeps the files too, so another checkpoint doesn't take them twice; a file
    that was changed since is another one.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    names = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.{vcf*,bcf}").option("maxFilesPerTrigger", files_per_batch).schema(schema).load(folder).select("path", "modificationTime")

    def take(batch: DataFrame, number: int) -> None:
        into = Dataset(spark, dataset, "w")
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]  # outlives restarts
        name = f"{stream}/{number}"
        known, fs = into._path("taken")
        if fs.exists(known):
            batch = batch.join(spark.read.schema(TAKEN).parquet(f"{into.uri}/taken").where(F.col("batch") != name), ["path", "modificationTime"], "left_anti")
        files = [tuple(r) for r in batch.collect()]  # at most files_per_batch names
        if files:
            into.ingest_samples([path for path, _ in files], batch=name)
            spark.createDataFrame([(*f, name) for f in files], TAKEN).coalesce(1).write.mode("append").parquet(f"{into.uri}/taken")

    return names.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_allele_counts(records: DataFrame) -> DataFrame:
    """Allele counts of a stream of records; write with output mode ``update`` or ``complete``."""
    return stats.allele_count(records)


def windowed_records(records: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Records per contig and window of ``ingest_ts``; rows later than ``late`` are left out of closed windows."""
    timed = records.withColumn("at", F.col("ingest_ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every), "contig").agg(F.count(F.lit(1)).alias("n_records"))
