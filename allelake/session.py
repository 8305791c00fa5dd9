"""Session facts every operator needs: the shared folder, the task count, and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: The one setting that names the folder all executors share.
SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where nothing is set and all runs on one machine (tests). On a cluster that setting is needed."""
    sc = spark.sparkContext
    named = spark.conf.get(SHARED, None) or sc.getConf().get(SHARED)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(f"{SHARED} must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="allelake-")
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver's Python ends."""
    ship(spark)  # what is written often comes from Python tasks
    path = f"{shared_dir(spark)}/allelake-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already
        pass


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it again.

    Unlike ``localCheckpoint`` the rows survive the loss of executors, and two
    consumers see the same rows even where the plan above is not deterministic.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per context; without it they'd need it on their own path."""
    sc = spark.sparkContext
    if getattr(sc, "_allelake_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="allelake-"), "allelake.zip")  # on the driver, which serves it
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(path)
    sc._allelake_shipped = True


def task_count(spark: SparkSession) -> int:
    """Number of reduce tasks the session is set to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
