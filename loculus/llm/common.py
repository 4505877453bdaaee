"""Helpers that every operator of this subpackage shares.

Intermediate results are cut off by writing them as Parquet under the folder
that the cluster names in ``spark.checkpoint.dir``; that folder is reachable
from the driver and from every executor, so a lost executor costs a re-read and
not a recomputation.  Nothing is ever kept in a machine-local folder.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loculus.session import read_parquet, shared_folder

#: A word: a run of characters other than space and the ASCII controls 9 to 13.
WORD_JAVA = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables."""
    return f"{shared_folder(spark)}/loculus"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file systems, whatever store it lies in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Named intermediate tables of one operator call, in a folder of their own.

    ``table`` writes a frame and returns it re-read; ``drop`` removes tables
    that nothing reads any more.  Tables behind a returned frame stay until the
    caller removes ``path`` (see ``delete_path``).
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def release(self) -> None:
        """Let Spark remove the shuffle files of phases whose results are stored by now.

        Spark does so when the driver's garbage collector finds their plans
        unreachable, which may take until long after the disks are full.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, f"{self.path}/{name}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table; one in a single small file, and so a single task, is dealt out to all cores."""
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_JAVA)), F.lit(0)).cast("long")


def spread_key(*columns: Column) -> Column:
    """A hash in hexadecimal that orders rows at random, the same in each run."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))
