"""The catalogue kept by change sets against a rebuild from all changes."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("google.protobuf")  # Spark's state interface for Python needs it

from loculus.streaming import catalogue  # noqa: E402


def changes(seed, batch, start):
    r = random.Random(seed * 100 + batch)
    rows = []
    for k in range(30):
        work = f"urn:cts:g:a.w{r.randrange(6)}"
        version = r.choice(["pub-eng1", "pub-eng2", "pub-grc1", "alt-eng3", "alt-grc9"])
        op = r.choice(["insert", "insert", "change", "remove"])
        rows.append((start + k, op, work, f"{work}.{version}", version, r.choice(["edition", "translation"]), version.startswith("alt"), r.choice([None, f"t{k}"]), k))
    return rows


def test_equals_a_rebuild_after_every_batch(spark, tmp_path):
    source, root, every = str(tmp_path / "changes"), str(tmp_path / "catalogue"), []
    assert catalogue.catalogue(spark, root).count() == 0
    touched = []
    for batch in range(3):
        rows = changes(1, batch, 1000 * batch)
        if batch == 2:  # one work goes entirely, and an old change comes late
            rows = [(5000 + k, "remove", r[2], r[3], *r[4:]) for k, r in enumerate({r[3]: r for r in every if r[2].endswith("w1")}.values())]
            late = next(r for r in every if r[2].endswith("w1"))
            rows += [(1, "insert", *late[2:7], "too late", late[8]), (6000, "insert", "urn:cts:g:a.new", "urn:cts:g:a.new.pub-eng1", "pub-eng1", "edition", False, None, 0)]
        every += rows
        frame = spark.createDataFrame(rows, catalogue.CHANGE)
        frame.coalesce(1).write.mode("append").parquet(source)
        catalogue.apply_changes(spark, source, root)
        now = catalogue.catalogue(spark, root)
        columns = sorted(now.columns)
        want = catalogue.rebuilt(spark.createDataFrame(every, catalogue.CHANGE))
        assert sorted(map(tuple, now.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)
        touched.append({r.work_urn for r in spark.read.parquet(f"{root}/works").where(F.col("batch") == batch).collect()})
    assert touched[2] == {"urn:cts:g:a.w1", "urn:cts:g:a.new"}  # no other work was decided anew
    assert not now.where(F.col("work_urn") == "urn:cts:g:a.w1").count() and now.where(F.col("work_urn") == "urn:cts:g:a.new").first().preferred
    catalogue.apply_changes(spark, source, root)  # nothing new
    assert catalogue.catalogue(spark, root).count() == now.count()
