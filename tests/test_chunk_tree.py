"""The chunk tree and its reading back, tokenization that stops at an unreachable service, build plans."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loculus.operators import endpoints
from loculus.sources import chunk_tree, documents

SCHEMA = "urn string, scheme string, pos int, cts_urn string, content string"


def test_tree_is_written_and_read_back(spark, tmp_path):
    urn = "urn:cts:greekLit:tlg1.tlg2.pub-grc1"
    rows = [(urn, "", k, f"{urn}:{k + 1}.1", f"<elements>{k} é</elements>") for k in range(12)] + [(urn, "card", 0, f"{urn}:5", "<elements/>"), ("urn:cts:g:a.b.c", "", 0, "urn:cts:g:a.b.c:1", None)]
    chunks = spark.createDataFrame(rows, SCHEMA).repartition(4)
    metadata = spark.createDataFrame([(urn, '{"document":{"title":"T"}}', "repo", "data/x.xml")], "urn string, json string, source_repo string, source_path string")
    for _ in range(2):  # a repeated run puts the same files in place
        written = chunk_tree.write_chunk_tree(chunks, metadata, str(tmp_path)).collect()
    folder = tmp_path / "greekLit/tlg1/tlg2/pub-grc1"
    assert len(written) == len({r.path for r in written}) == 14 + 3 + 2
    assert sorted(os.listdir(folder)) == sorted([*(f"{k + 1}.1.xml" for k in range(12)), "index.json", "metadata.json", "card"])
    assert (folder / "3.1.xml").read_text() == "<elements>2 é</elements>" and (folder / "card/5.xml").exists()
    about = json.loads((folder / "card/metadata.json").read_text())["document"]
    assert about == {"title": "T", "source_repo": "repo", "source_path": "data/x.xml"}
    indexes = spark.read.text(str(folder / "index.json"), wholetext=True).select(F.lit(urn).alias("version"), F.col("value").alias("json"))
    read = documents.chunk_index(indexes).orderBy("pos").collect()
    assert [(r.cts_urn, r.file) for r in read] == [(f"{urn}:{k + 1}.1", f"{k + 1}.1.xml") for k in range(12)]


def test_tokenizing(spark, tmp_path):
    asked = str(tmp_path)

    def service(urn, text):
        open(f"{asked}/{urn}", "w").close()  # noqa: SIM115
        if "down" in text:
            raise ConnectionError("refused")
        if "odd" in text:
            raise ValueError("no such language")
        return [{"text": w} for w in text.split()]

    chunks = spark.createDataFrame([("1", "u1", "a b"), ("2", "u2", "  "), ("3", "u3", "odd"), ("4", "u4", "x"), ("5", "u5", None)], "chunk string, urn string, text string")
    got = {r.chunk: (r.status, r.error, len(json.loads(r.json)["tokens"]) if r.json else None) for r in chunk_tree.tokenize_chunks(chunks, service, done=chunks.where("chunk = '4'")).collect()}
    assert got == {"1": ("generated", None, 2), "2": ("generated", None, 0), "3": ("failed", "no such language", None), "4": ("skipped", None, None), "5": ("generated", None, 0)}
    assert sorted(os.listdir(asked)) == ["u1", "u3"]
    many = spark.range(200).select(F.col("id").cast("string").alias("chunk"), F.concat(F.lit("v"), "id").alias("urn"), F.when(F.col("id") == 3, "down").otherwise("up").alias("text")).coalesce(1)
    with pytest.raises(Exception, match="the tokenizing service was not reached: refused"):
        chunk_tree.tokenize_chunks(many, service).collect()
    assert len([f for f in os.listdir(asked) if f.startswith("v")]) == 4  # nothing behind the first that failed was asked for


def test_build_plans(spark):
    pages = spark.range(300).select(F.lit("reading_view").alias("endpoint"), F.concat(F.lit("/u/"), "id").alias("url"))
    urls = pages.union(pages.limit(5)).union(spark.createDataFrame([("search_index", "/s.json"), ("urn_index", "/u.json")], "endpoint string, url string"))
    plan = lambda *a, **k: {r.url for r in endpoints.build_plan(urls, *a, **k).collect()}
    every = plan()
    assert len(every) == 302 and plan("global-only", manifests=2) == {"/s.json", "/u.json"}
    shards = [plan("corpus-only", k, 4) for k in range(4)]
    assert set().union(*shards) == every - {"/s.json", "/u.json"} and sum(map(len, shards)) == 300 and all(shards)
    for bad, why in ((("global-only",), "manifest"), (("full", 4, 4), "not in"), (("half",), "none of")):
        with pytest.raises(ValueError, match=why):
            endpoints.build_plan(urls, *bad)
