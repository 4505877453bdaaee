"""The stored word index: blocks of hits against plain lists, what a page reads, readings by lemma, languages."""

import random

import pytest
from pyspark.sql import functions as F

from loculus.operators import search, search_index

BLOCK = 8


def sample(seed=3):
    """(doc_id, text, lang): a word in nearly every place, rarer ones, documents of very different lengths, an empty and a null text."""
    r = random.Random(seed)
    rows = [(k, " ".join(r.choice(["the", "the", "the", "roses", "rosen", "Roses,", "x"]) for _ in range(r.choice([3, 40, 400]))), r.choice(["en", "de"])) for k in range(40)]
    return [*rows, (50, "", "en"), (51, None, "en"), (52, "lone", None)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = sample()
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    folder = search_index.write_index(texts, str(tmp_path_factory.mktemp("index")), chunk_tokens=10, chunks_a_document=1000, block_hits=BLOCK)
    return rows, search_index.open_index(spark, folder)


def places(rows, match):
    """(chunk_id, seq, occ, doc_id, form, lang) in reading order."""
    out = []
    for doc, text, lang in rows:
        seen = {}
        for k, token in enumerate((text or "").split()):
            form, chunk = token.strip(",").lower(), doc * 1000 + k // 10
            seen[chunk, form] = seen.get((chunk, form), 0) + 1
            if match(form, lang or ""):
                out.append((chunk, k + 1, seen[chunk, form], doc, form, lang or ""))
    return sorted(out)


def test_blocks_hold_every_hit_in_order(built):
    rows, index = built
    for form, lang in (("the", "en"), ("the", "de"), ("roses", "en"), ("lone", "")):
        blocks = index.form_blocks.where((F.col("form") == form) & (F.col("lang") == lang)).orderBy("block").collect()
        assert [b.block for b in blocks] == list(range(len(blocks))) and all(b.n == len(b.hits) for b in blocks)
        assert all(b.n == BLOCK for b in blocks[:-1]) and 0 < blocks[-1].n <= BLOCK
        hits = [(h.chunk_id, h.seq, h.occ, h.doc_id) for b in blocks for h in b.hits]
        assert hits == [p[:4] for p in places(rows, lambda f, g, form=form, lang=lang: (f, g) == (form, lang))]
        assert [(b.from_chunk, b.from_seq) for b in blocks] == [(-1, -1), *((b.last_chunk, b.last_seq) for b in blocks[:-1])]


@pytest.mark.parametrize("limit", [1, 7, 8, 50])
def test_pages_go_through_all_hits(built, limit):
    rows, index = built
    wanted = [("the", "en"), ("roses", "en"), ("roses", "de")]
    every = [p[:2] for p in places(rows, lambda f, g: (f, g) in wanted)]
    r = random.Random(limit)
    for start in [-1, *r.sample(range(len(every)), 3), len(every) - 1]:
        after = (-1, -1) if start < 0 else every[start]
        page = search_index.hits_page(index.form_blocks, wanted, after, limit, block_hits=BLOCK).collect()
        assert [(x.chunk_id, x.seq) for x in page] == every[start + 1 : start + 1 + limit]


def test_page_inside_a_work(built):
    rows, index = built
    doc = max(rows, key=lambda r: len(r[1] or ""))[0]
    own = [p[:2] for p in places(rows, lambda f, g: f == "the") if p[0] // 1000 == doc]
    span = index.documents.where(F.col("doc_id") == doc).first()
    wanted = [("the", "en"), ("the", "de")]
    page = lambda after: [(x.chunk_id, x.seq) for x in search_index.hits_page(index.form_blocks, wanted, after, 20, (span.first_chunk, span.last_chunk), BLOCK).collect()]
    assert page((-1, -1)) == own[:20] and page(own[-5]) == own[-4:] and page(own[-1]) == []
    assert search_index.hits_page(index.form_blocks, [("nowhere", "en")], block_hits=BLOCK).count() == 0


def scanned(frame):
    """Rows that the frame's scans have given, as the plan that ran has counted them."""
    spark = frame.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame.collect()
        leaves, total = frame._jdf.queryExecution().executedPlan().collectLeaves(), 0
        for k in range(leaves.length()):
            total += leaves.apply(k).metrics().get("numOutputRows").get().value()
        return total
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_page_reads_few_blocks(spark, tmp_path):
    """Of 3,000 blocks of one form a cursor's search and its page read those of a few Parquet pages."""
    texts = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the "), 400).alias("text"), F.lit("en").alias("lang"))
    index = search_index.open_index(spark, search_index.write_index(texts, str(tmp_path), chunks_a_document=1000, block_hits=BLOCK))
    assert index.form_blocks.count() == 3000
    for after in ((-1, -1), (30_002, 250), (59_003, 390)):
        near = search_index.block_behind(index.form_blocks, [("the", "en")], after)
        page = search_index.hits_page(index.form_blocks, [("the", "en")], after, 10, block_hits=BLOCK)
        assert scanned(near) <= 192 and scanned(page) <= 192 and page.count() == 10
    with pytest.raises(ValueError, match="budget"):
        search_index.all_hits(index.form_blocks, [("the", "en")], budget=1000)
    with pytest.raises(ValueError, match="bytes"):
        search_index.hits_page(index.form_blocks, [("the", "en")], limit=10, budget=100)


def test_lemmas_join_the_hits_of_their_forms(built):
    rows, index = built
    hits = search_index.all_hits(index.lemma_blocks, [("rose", "de"), ("rose", "en")]).join(index.features, "feat_id").collect()
    want = places(rows, lambda f, g: f in ("roses", "rosen"))
    assert sorted((h.chunk_id, h.seq, h.occ, h.doc_id, h.form, h.lang) for h in hits) == want
    assert all(h.feats == f"Ending={h.form[-1]}" and h.lemma == "rose" for h in hits)
    counts = {(r.doc_id): (r.n, r.forms) for r in index.lemma_counts.where("lemma = 'rose'").collect()}
    for doc in {w[3] for w in want}:
        own = [w for w in want if w[3] == doc]
        assert counts[doc] == (len(own), len({w[4] for w in own}))
    twice = {r.lemma: r.weight for r in index.analyses.where("form = 'roses' and lang = 'en'").collect()}
    assert twice == {"roses": 1, "rose": 2}


def test_fill_reads_only_the_works_it_touches(built):
    rows, index = built
    wanted = [("the", "en"), ("the", "de")]
    works = search.counts_by_document(index.form_counts, search_index.find_keys(index.forms, "the"), index.documents)
    asked = []

    def hits(spans):
        asked.extend(spans)
        return search_index.hits_in_chunks(index.form_blocks, wanted, spans)

    got = search.fill_across_works(hits, works, index.documents, 100, 60, most_works=5).orderBy("hit").collect()
    every = places(rows, lambda f, g: f == "the")
    counted = {d: sum(p[3] == d for p in every) for d in {p[3] for p in every}}
    rate = {r.doc_id: r.rate for r in works.collect()}
    best = sorted(counted, key=lambda d: (-counted[d], -rate[d], d))[:5]
    line = [p for d in best for p in every if p[3] == d]
    assert [(g.hit, g.chunk_id, g.seq) for g in got] == [(k, *line[k][:2]) for k in range(100, min(160, len(line)))]
    assert len(asked) <= 5


def test_spaced_context(spark):
    texts = spark.createDataFrame([(1, "one,  two\tthree; four"), (2, None)], "doc_id long, text string")
    rows = search.spaced_context(texts, lambda t: F.lower(t).isin("two", "four", "one"), width=2).orderBy("pos").collect()
    assert [(r.before, r.hit, r.after) for r in rows] == [("", "one", ", two "), ("one, ", "two", " three; "), ("three; ", "four", "")]


def test_a_passage_is_found_in_few_pages(spark, tmp_path):
    from loculus.operators import toc

    chunks = spark.range(40_000).select(F.format_string("urn:%06d", "id").alias("urn"), F.col("id").alias("pos"))
    table = spark.read.parquet(toc.write_passages(chunks, str(tmp_path / "passages")))
    found = toc.find_passages(table, ["urn:000007", "urn:031234", "urn:9"])
    assert sorted(r.pos for r in found.collect()) == [7, 31234]
    assert scanned(toc.find_passages(table, ["urn:031234"])) <= 2000
