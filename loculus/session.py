"""Session settings that the library is written for, and the folder for tables that it stores."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}
#: A table in one file of up to so many bytes is dealt out to all cores after reading; larger ones have enough row groups.
SINGLE_FILE_BYTES = 512 << 20


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass ``SETTINGS`` to the submitter."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config(map=SETTINGS | {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(shuffle_partitions)} | settings)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A local session without one gets a temporary folder; on a cluster that is an error, since executors would each
    write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        base = "file://" + tempfile.mkdtemp(prefix="loculus-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """Where stored tables go."""
    return f"{shared_folder(spark)}/loculus-tables"


def stored(frame: DataFrame) -> DataFrame:
    """The frame written to the work folder and read again, so that it is computed once and its rows stay as they are."""
    path = f"{work_folder(frame.sparkSession)}/{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file systems, whatever store it lies in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what is stored by now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def file_status(spark: SparkSession, path: str):
    """Hadoop's status of a path, or None where there is nothing."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.getFileStatus(target) if store.exists(target) else None


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; one that is a single small file, and so a single task, is dealt out to all cores."""
    table, status = spark.read.parquet(path), file_status(spark, path)
    if status is not None and status.isFile() and status.getLen() <= SINGLE_FILE_BYTES:
        return table.repartition(spark.sparkContext.defaultParallelism)
    return table
