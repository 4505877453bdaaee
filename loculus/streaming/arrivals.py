"""Incremental ingest as a stream: new files in a staging folder, each document once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType, most_files: int = 1000) -> DataFrame:
    """Rows of Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def first_of_each(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each key once; keys are forgotten after ``late``, so the state stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts_in_windows(stream: DataFrame, time: str, by: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind, final once the window is past lateness."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def keep_up(stream: DataFrame, target: str, checkpoint: str, partition: str) -> StreamingQuery:
    """Append each batch to a partitioned table, once: a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(partition).parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
