"""A catalogue kept up to date by change sets: only the works that a change touches are decided anew.

Changes (seq, op, work_urn, urn, and what is known of the version) arrive as
files.  A stateful operator keeps, for each work, the last change of every
version; a batch of changes wakes the works that it names, and each of them
hands on its versions as they are now.  What follows from a work as a whole (the
preferred versions) is computed for these works only, and each batch is stored in
a folder of its own, so a repeated batch overwrites itself.  The catalogue is the
latest state of every work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from loculus.operators.catalog import with_preferred
from loculus.session import file_status

#: Columns of a change beside those of a version, which ``CHANGE`` lists first.
CHANGE = "seq long, op string, work_urn string, urn string, version string, kind string, experimental boolean, title string, pos long"
VERSION = [c.split()[0] for c in CHANGE.split(", ")][3:]
REMOVE = "remove"


class WorkState(StatefulProcessor):
    """The last change of each version of a work; removals are remembered too, so that an older change that comes late stays without effect."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.versions = handle.getMapState("versions", "urn string", "seq long, op string, fields string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest: dict[str, tuple] = {}
        for frame in rows:
            for row in frame.to_dict("records"):
                if row["urn"] not in latest or latest[row["urn"]][0] <= row["seq"]:
                    fields = {c: None if pd.isna(row[c]) else row[c] for c in VERSION}
                    latest[row["urn"]] = (int(row["seq"]), row["op"], json.dumps(fields, default=lambda x: x.item()))
        for urn, (seq, op, fields) in latest.items():
            known = self.versions.getValue((urn,)) if self.versions.containsKey((urn,)) else None
            if known is None or known[0] <= seq:
                self.versions.updateValue((urn,), (seq, op, fields))
        now = [json.loads(v[2]) for _, v in self.versions.iterator() if v[1] != REMOVE]
        # a work without versions is told of by a row without one
        out = pd.DataFrame(now or [dict.fromkeys(VERSION)], columns=VERSION)
        out.insert(0, "work_urn", key[0])
        yield out.astype({"experimental": object, "pos": "Int64"})

    def close(self) -> None:
        pass


def _schema() -> str:
    return "work_urn string, " + ", ".join(CHANGE.split(", ")[3:])


def touched_works(changes: DataFrame) -> DataFrame:
    """The stream of works that a batch of changes touches, each with its versions as they are then."""
    return changes.groupBy("work_urn").transformWithStateInPandas(WorkState(), _schema(), "Update", "None")


def _store(batch: DataFrame, number: int, root: str) -> None:
    kept = batch.persist()
    there = with_preferred(kept.where("urn is not null"), ["work_urn"], "pos")
    gone = kept.where("urn is null").withColumn("preferred", F.lit(None).cast("boolean"))
    there.unionByName(gone).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/works/batch={number}")
    kept.unpersist()


def apply_changes(spark: SparkSession, changes: str, root: str, most_files: int = 1000) -> None:
    """Apply the change files that have arrived in a folder since the last call; state and catalogue lie below ``root``."""
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    stream = spark.readStream.schema(StructType.fromDDL(CHANGE)).option("maxFilesPerTrigger", most_files).parquet(changes)
    sink = touched_works(stream).writeStream.outputMode("update").foreachBatch(partial(_store, root=root))
    sink.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """The versions of all works with ``preferred``: of each work what its latest batch has left."""
    schema = StructType.fromDDL(f"{_schema()}, preferred boolean, batch long")
    if file_status(spark, f"{root}/works") is None:
        return spark.createDataFrame([], schema).drop("batch")
    log = spark.read.schema(schema).parquet(f"{root}/works")
    last = log.groupBy("work_urn").agg(F.max("batch").alias("batch"))
    return log.join(last, ["work_urn", "batch"]).where("urn is not null").drop("batch")


def rebuilt(changes: DataFrame) -> DataFrame:
    """The same from all changes at once: of each version its last change, then the preferred ones of each work."""
    last = F.row_number().over(Window.partitionBy("work_urn", "urn").orderBy(F.desc("seq")))
    kept = changes.withColumn("_last", last).where((F.col("_last") == 1) & (F.col("op") != REMOVE))
    return with_preferred(kept.select("work_urn", *VERSION), ["work_urn"], "pos")
