"""Snapshots named by their content: written aside, checked, moved to their name, and only then pointed to.

A root holds ``snapshots/<digest>`` and the pointer file ``CURRENT``, which names
the current and the previous snapshot.  The pointer is replaced by a rename, so a
reader sees the old or the new one; whatever fails before that leaves the old
snapshot live, and what it has written is removed by the next publication.  The
digest doesn't depend on the order of rows or on how they lie in files, so the
same content has the same name wherever it is published, and a snapshot can be
pulled and checked by its name.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loculus.operators.publish import LEAST_SHARE
from loculus.session import file_status

POINTER, SNAPSHOTS, STAGING = "CURRENT", "snapshots", "staging"


@dataclass(frozen=True)
class Pointer:
    """What ``CURRENT`` says."""

    current: str
    previous: str | None
    rows: int


def content_digest(frame: DataFrame) -> tuple[str, int]:
    """(digest, rows) of a frame: column names and types, and sums of the rows' checksums, whatever their order."""
    columns = sorted(frame.columns)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substr(row, F.lit(at), F.lit(15)), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    rows, *sums = frame.agg(F.count("*"), *[part(at) for at in (1, 16, 31, 46)]).first()
    kinds = sorted((f.name, f.dataType.simpleString()) for f in frame.schema.fields)
    return hashlib.sha256(json.dumps([kinds, rows, sums]).encode()).hexdigest()[:32], rows


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, source: str, target: str, overwrite: bool) -> None:
    """An atomic rename; with ``overwrite`` it replaces the target."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if overwrite else kind.NONE
    start = jvm.org.apache.hadoop.fs.Path(source)
    _, store = _hadoop(spark, source)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(start, jvm.org.apache.hadoop.fs.Path(target), how)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target, store = _hadoop(spark, path)
    out = store.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def pointer(spark: SparkSession, root: str) -> Pointer | None:
    """What is live; None before the first publication."""
    if file_status(spark, f"{root}/{POINTER}") is None:
        return None
    return Pointer(**json.loads("\n".join(r["value"] for r in spark.read.text(f"{root}/{POINTER}").collect())))


def _point(spark: SparkSession, root: str, to: Pointer) -> None:
    draft = f"{root}/{STAGING}/pointer-{uuid.uuid4().hex}"
    _write_text(spark, draft, json.dumps(asdict(to), sort_keys=True))
    _rename(spark, draft, f"{root}/{POINTER}", overwrite=True)


def read_snapshot(spark: SparkSession, root: str, digest: str | None = None) -> DataFrame:
    """The snapshot with the digest, or the current one."""
    live = pointer(spark, root)
    if digest is None and live is None:
        raise FileNotFoundError(f"404: nothing is published at {root}")
    return spark.read.parquet(f"{root}/{SNAPSHOTS}/{digest or live.current}")


def publish_snapshot(frame: DataFrame, root: str, has_index: Column | None = None, expected: str | None = None) -> str:
    """Publish a frame and return its digest.

    What was written is read back for the checks: rows enough against the live snapshot, some row for which
    ``has_index`` holds, and the digest that is expected, if one is.  A snapshot that is there already isn't written
    to its name again.  All but the current and the previous snapshot are removed at the end.
    """
    spark, staged = frame.sparkSession, f"{root}/{STAGING}/{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(staged)
    written = spark.read.schema(frame.schema).parquet(staged)
    digest, rows = content_digest(written)
    live = pointer(spark, root)
    if expected is not None and digest != expected:
        raise ValueError(f"snapshot has digest {digest}, not {expected}")
    if live is not None and rows < LEAST_SHARE * live.rows:
        raise ValueError(f"snapshot {digest} has {rows} rows of {live.rows} live ones")
    if has_index is not None and not written.where(has_index).limit(1).count():
        raise ValueError(f"snapshot {digest} has no index")
    if file_status(spark, f"{root}/{SNAPSHOTS}/{digest}") is None:
        target, store = _hadoop(spark, f"{root}/{SNAPSHOTS}")
        store.mkdirs(target)
        _rename(spark, staged, f"{root}/{SNAPSHOTS}/{digest}", overwrite=False)
    if live is None or live.current != digest:
        _point(spark, root, Pointer(digest, live.current if live else None, rows))
    remove_stale(spark, root)
    return digest


def roll_back(spark: SparkSession, root: str) -> str:
    """Make the previous snapshot current again, and the current one the previous."""
    live = pointer(spark, root)
    if live is None or live.previous is None:
        raise ValueError(f"nothing to roll back to at {root}")
    _point(spark, root, Pointer(live.previous, live.current, spark.read.parquet(f"{root}/{SNAPSHOTS}/{live.previous}").count()))
    return live.previous


def remove_stale(spark: SparkSession, root: str) -> list[str]:
    """Delete snapshots that the pointer doesn't name, and all that was left in staging; returns the snapshots' names."""
    live, gone = pointer(spark, root), []
    kept = {live.current, live.previous} if live else set()
    folder, store = _hadoop(spark, f"{root}/{SNAPSHOTS}")
    if store.exists(folder):
        for status in store.listStatus(folder):
            if status.getPath().getName() not in kept:
                store.delete(status.getPath(), True)
                gone.append(status.getPath().getName())
    staging, store = _hadoop(spark, f"{root}/{STAGING}")
    store.delete(staging, True)
    return sorted(gone)


def pull(spark: SparkSession, source: str, target: str) -> str | None:
    """Bring the current snapshot of another root here if its digest is new; returns the digest, None if there was nothing to do.

    What arrives is checked against the digest that the source names before anything points to it.
    """
    there, here = pointer(spark, source), pointer(spark, target)
    if there is None:
        raise FileNotFoundError(f"404: nothing is published at {source}")
    if here is not None and here.current == there.current:
        return None
    return publish_snapshot(read_snapshot(spark, source, there.current), target, expected=there.current)
