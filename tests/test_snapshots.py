"""Snapshots by content: names, checks, crashes, retention, pulling."""

import pytest
from pyspark.sql import functions as F

from loculus.operators import snapshots


def frame(spark, n, start=0):
    return spark.range(start, start + n).select("id", (F.col("id") % 3).alias("kind"), F.when(F.col("id") % 2 == 0, F.array("id")).alias("list"))


def test_digest_is_of_content_not_of_layout(spark):
    one = frame(spark, 50)
    digest = snapshots.content_digest(one)
    assert digest == snapshots.content_digest(one.orderBy(F.desc("id")).repartition(7).select("list", "id", "kind")) and digest[1] == 50
    others = [one.union(one.limit(1)), one.where("id < 49"), one.withColumn("kind", F.lit(0).cast("long")), one.withColumnRenamed("kind", "sort"), one.withColumn("kind", F.col("kind").cast("int"))]
    assert len({snapshots.content_digest(o)[0] for o in [one, *others]}) == 6
    assert snapshots.content_digest(one.limit(0))[1] == 0


def test_publication(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError, match="404"):
        snapshots.read_snapshot(spark, root)
    first = snapshots.publish_snapshot(frame(spark, 10), root, has_index=F.col("kind") == 1)
    assert snapshots.pointer(spark, root) == snapshots.Pointer(first, None, 10) and snapshots.read_snapshot(spark, root).count() == 10
    assert snapshots.publish_snapshot(frame(spark, 10).repartition(3), root) == first  # the same content again changes nothing
    assert snapshots.pointer(spark, root) == snapshots.Pointer(first, None, 10)
    second = snapshots.publish_snapshot(frame(spark, 12), root)
    third = snapshots.publish_snapshot(frame(spark, 14), root)
    assert snapshots.pointer(spark, root) == snapshots.Pointer(third, second, 14)
    assert sorted(p.name for p in (tmp_path / "snapshots").iterdir()) == sorted([second, third])  # the first is gone
    assert snapshots.roll_back(spark, root) == second and snapshots.pointer(spark, root) == snapshots.Pointer(second, third, 12)


def test_what_fails_the_checks_is_never_live(spark, tmp_path):
    root = str(tmp_path)
    first = snapshots.publish_snapshot(frame(spark, 20), root)
    for bad, has_index, expected, why in ((frame(spark, 9), None, None, "9 rows of 20"), (frame(spark, 20, 5), F.col("kind") == 7, None, "no index"), (frame(spark, 20, 5), None, "x", "not x")):
        with pytest.raises(ValueError, match=why):
            snapshots.publish_snapshot(bad, root, has_index=has_index, expected=expected)
        assert snapshots.pointer(spark, root).current == first and snapshots.read_snapshot(spark, root).count() == 20


@pytest.mark.parametrize("at", ["_rename", "_point"])
def test_a_crash_leaves_the_old_snapshot_live(spark, tmp_path, monkeypatch, at):
    root = str(tmp_path)
    first = snapshots.publish_snapshot(frame(spark, 20), root)

    def crash(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(snapshots, at, crash)
        snapshots.publish_snapshot(frame(spark, 25), root)
    assert snapshots.pointer(spark, root).current == first and snapshots.read_snapshot(spark, root).count() == 20
    second = snapshots.publish_snapshot(frame(spark, 25), root)
    assert snapshots.pointer(spark, root) == snapshots.Pointer(second, first, 25) and not list((tmp_path / "staging").glob("*"))


def test_pulling_by_digest(spark, tmp_path):
    there, here = str(tmp_path / "there"), str(tmp_path / "here")
    digest = snapshots.publish_snapshot(frame(spark, 15), there)
    assert snapshots.pull(spark, there, here) == digest and snapshots.pull(spark, there, here) is None
    newer = snapshots.publish_snapshot(frame(spark, 16), there)
    spark.range(3).select("id", F.lit(1).cast("long").alias("kind"), F.array("id").alias("list")).write.mode("append").parquet(f"{there}/snapshots/{newer}")  # damaged on the way
    with pytest.raises(ValueError, match="not " + newer):
        snapshots.pull(spark, there, here)
    assert snapshots.pointer(spark, here).current == digest
