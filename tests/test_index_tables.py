"""What queries build of the word index, and blocks that lie in several ranges, against plain lists."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loculus.operators import postings, search_index
from loculus.operators.tokens import bare_surface
from loculus.plans import bindings
from loculus.plans.catalogue import QUERIES
from loculus.session import work_folder

DATA = "/root/testdata/sf0.001"
BUILT = {
    "form_lookup_exact": {"forms"},
    "form_lookup_language": {"forms"},
    "form_lookup_loose": {"forms"},
    "hits_described": {"forms", "features", "chunks", "form_blocks"},
    "hits_fill": {"documents", "forms", "form_blocks"},
    "hits_page": {"forms", "form_blocks"},
    "hits_page_in_work": {"documents", "forms", "form_blocks"},
    "kwic_parts": {"form_blocks", "parts"},
    "latin_keys": {"forms"},
    "lemma_counts_by_doc": {"documents", "forms", "analyses", "lemmas", "form_counts"},
    "lemma_hits_described": {"forms", "analyses", "features", "lemmas", "chunks", "form_blocks"},
    "lemma_hits_page": {"forms", "analyses", "lemmas", "form_blocks"},
    "lemma_lookup": {"forms", "analyses", "lemmas"},
    "lemma_readings": {"forms", "analyses", "features"},
    "loose_keys": {"forms"},
    "rate_labels": {"documents", "forms", "form_counts"},
    "top_forms": {"forms"},
    "word_counts_by_doc": {"documents", "forms", "form_counts"},
    "word_total": {"documents", "forms", "form_counts"},
}


@pytest.mark.parametrize("name", sorted(BUILT))
def test_a_query_builds_only_what_it_reads(spark, monkeypatch, name):
    monkeypatch.setattr(bindings, "_built", {})
    monkeypatch.setattr(bindings, "_indexed", {}, raising=False)
    root = f"{work_folder(spark)}/search".removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    QUERIES[name](spark, DATA).collect()
    assert {t for folder in set(os.listdir(root)) - before for t in os.listdir(f"{root}/{folder}") if "." not in t} == BUILT[name]


@pytest.mark.parametrize("partitions", [3, 23])
def test_blocks_across_ranges(spark, tmp_path, partitions):
    """Documents of segments of their own, so that one form lies in several ranges, and blocks in two or more."""
    r = random.Random(partitions)
    rows = [(k * 5000, " ".join(r.choice(["the", "The,", "été!", "x", "--", "rare%d" % r.randrange(50)]) for _ in range(r.choice([1, 30, 300]))), "en") for k in range(-3, 60)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        texts = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
        index = search_index.open_index(spark, search_index.write_index(texts, str(tmp_path), chunk_tokens=10, block_hits=8, tables=["form_blocks", "form_counts"]))
        assert index.forms is None and spark.read.parquet(*index.form_blocks.inputFiles()).where("not whole").count() > 0
        got = index.form_blocks.orderBy("form", "block").collect()
        counts = {(c.form, c.doc_id): c.n for c in index.form_counts.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want, seen = {}, {}
    for doc, text, _ in rows:
        for k, token in enumerate(text.split()):
            form = token.strip("-,!").lower()
            if form:
                chunk = doc * search_index.CHUNKS_A_DOCUMENT + k // 10
                seen[form, chunk] = seen.get((form, chunk), 0) + 1
                want.setdefault(form, []).append((chunk, k + 1, seen[form, chunk], doc))
    for form, hits in want.items():
        own = [b for b in got if b.form == form]
        hits.sort()
        assert [(h.chunk_id, h.seq, h.occ, h.doc_id) for b in own for h in b.hits] == hits
        assert [b.block for b in own] == list(range(len(own))) and all(b.n == len(b.hits) for b in own) and all(b.n == 8 for b in own[:-1])
        assert [(b.from_chunk, b.from_seq) for b in own] == [(-1, -1), *((b.last_chunk, b.last_seq) for b in own[:-1])]
        assert [(b.last_chunk, b.last_seq) for b in own] == [(b.hits[-1].chunk_id, b.hits[-1].seq) for b in own]
    assert counts == {(form, d): sum(h[3] == d for h in hits) for form, hits in want.items() for d in {h[3] for h in hits}}


def test_ascii_tokens_are_made_bare_as_others(spark):
    import pyarrow as pa

    ends = [chr(c) for c in range(1, 128) if not chr(c).isspace() or chr(c) in "\x1c\x1d\x1e\x1f"]
    tokens = [a + m + b for a in ends for b in ends for m in ("", "X-y")] + ends
    frame = spark.createDataFrame([(t,) for t in tokens], "t string")
    assert [r.s for r in frame.select(bare_surface(F.col("t")).alias("s")).collect()] == postings.bare_ascii(pa.array(tokens)).to_pylist()
