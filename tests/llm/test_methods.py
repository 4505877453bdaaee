"""What each method promises: recall, links, learned rules, discovered identifiers, frames, balance, the pipeline's decisions."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import words

SMALL = "/root/testdata/sf0.001"


def test_neighbours_recall(spark, scratch):
    from loculus.llm.hnsw import nearest

    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 24))
    data = (centres[r.integers(0, 12, 3000)] + 0.4 * r.normal(size=(3000, 24))).astype(np.float32)
    data[500:900] = data[0]  # one vector that very many rows share
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id long, embedding array<float>")
    found = nearest(frame, scratch, F.pmod("vec_id", F.lit(100)) == 0, k=10, shard_rows=800).collect()
    hit = 0
    for q in range(0, 3000, 100):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        exact = np.sqrt(((data.astype(float) - data[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(3000), exact)) if i != q][:10]
        assert len(mine) == 10 and all(abs(r.score - exact[r.vec_id]) < 1e-12 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hit += len({r.vec_id for r in mine} & set(order))
    assert hit >= 0.9 * 300


def shard_recall(data, step):
    """Recall of ten nearest in one shard's graph, every ``step``-th row as query."""
    from loculus.llm.hnsw import build_graph, search_graph

    graph = build_graph(np.arange(len(data)), data, 11)
    asked = np.arange(0, len(data), step)
    query, found, _ = search_graph(graph, asked, data[asked], 10)
    hit, exact = 0, data.astype(float)
    for q in asked:
        far = ((exact - exact[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hit += len(set(np.argsort(far, kind="stable")[:10]) & set(found[query == q].tolist()))
    return hit / (10 * len(asked))


@pytest.mark.parametrize("kind", ["gauss", "clusters", "full shard"])
def test_an_average_vector_leaves_the_graph_connected(kind):
    from loculus.llm.hnsw import MOST_SHARD_ROWS

    r = np.random.default_rng(1)
    rows = MOST_SHARD_ROWS if kind == "full shard" else 4000
    data = r.normal(size=(rows, 64)).astype(np.float32)
    if kind == "clusters":
        data = (r.normal(size=(50, 64))[r.integers(0, 50, rows)] + 0.3 * data).astype(np.float32)
    data[7] = data.mean(axis=0)  # nearer to every row than the rows are to each other
    data[8] = 0.01
    assert shard_recall(data, rows // 100) >= 0.9


def test_popular_targets_hold_memory():
    """Every new row's nearest is one and the same: offers are cut before they are compared."""
    import tracemalloc

    from loculus.llm.hnsw import build_graph

    r = np.random.default_rng(2)
    data = r.normal(size=(6000, 64)).astype(np.float32)
    data[0] = 0.001
    tracemalloc.start()
    try:
        build_graph(np.arange(6000), data, 11)
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
    finally:
        tracemalloc.stop()


def test_double_vectors_keep_their_distances(spark, scratch):
    from loculus.llm.hnsw import nearest

    rows = [(k, [1.0 + k * 1e-12, 2.0, 3.0]) for k in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest(frame, scratch, F.col("vec_id") == 0, k=5).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(found, key=lambda r: r["rank"])] == [(k, k) for k in range(1, 6)]
    assert all(abs(r.score - (1.0 + r.vec_id * 1e-12 - 1.0)) < 1e-16 for r in found)


@pytest.mark.parametrize("dense", [False, True])
def test_links_connect_like_all_pairs(dense):
    from loculus.llm import simhash

    r = np.random.default_rng(7)
    if dense:  # thousands within a few bits of each other, and a chain
        bits = r.integers(0, 14, (6000, 5))
        fps = np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64), axis=1) | np.uint64(0xABC0000000000000)
    else:
        seeds = r.integers(0, 1 << 63, 300, dtype=np.uint64)
        fps = np.concatenate([seeds, *[seeds ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)) for _ in range(4)]])
    fps = np.unique(fps)
    pairs = {(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3) + i + 1}
    variants = []
    for n in range(64):
        seg = fps >> np.uint64(32) if n < 32 else fps & np.uint64(0xFFFFFFFF)
        variants.append((np.uint64(n) << np.uint64(32)) + (seg & ~(np.uint64(1) << np.uint64(n % 32))))
    signature, every = np.concatenate(variants).view(np.int64), np.tile(fps, 64)
    order = np.lexsort((every, signature))
    links = simhash.link_groups(signature[order], every[order])
    assert (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= 3).all()
    place = {int(f): i for i, f in enumerate(fps)}
    assert roots(len(fps), pairs) == roots(len(fps), [(place[int(a)], place[int(b)]) for a, b in links])


def roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark, scratch):
    from loculus.llm.graph import components

    r = random.Random(2)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(900, k) for k in range(901, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), scratch).collect()}
    want = roots(1000, pairs)
    assert got == {n: want[n] for p in pairs for n in p if want[n] != n or any(want[m] == n for m in range(1000) if m != n)}


def test_fingerprint_matches_its_definition():
    from loculus.llm.simhash import fingerprint

    text = words(4, 700) + " Ünï ÀB"
    parts = [w for w in re.split(r"[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[i : i + 3]), 42) for i in range(len(parts) - 2)]
    assert fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_rules_generalize():
    from loculus.llm.quality import FEATURES, learn_rules

    r = np.random.default_rng(1)
    n = 3000
    data = {f: r.random(n) for f in FEATURES}
    bad = (data["symbols_per_word"] > 0.8) | ((data["words"] < 0.2) & (data["mean_word_chars"] > 0.6))
    rules = learn_rules({f: x[:2000] for f, x in data.items()}, bad[:2000], np.arange(2000) % 3 == 0)
    fresh = {f: x[2000:] for f, x in data.items()}
    said = np.zeros(1000, bool)
    for rule in rules:
        said |= rule.covers(fresh, 1000)
    assert (said == bad[2000:]).mean() > 0.97 and (said & ~bad[2000:]).sum() < 15
    assert 2 <= len(rules) <= 16 and all("and" in x.sql() or ">=" in x.sql() or "<" in x.sql() for x in rules)


def test_contexts_discover_identifiers(spark, scratch):
    from loculus.llm.pii import span_report

    r = random.Random(5)
    known = [(k, f"{words(k, 5)} reach desk via +1 (555) 010-{1000 + k} today") for k in range(30)]
    unseen = [(100, "please reach desk via 5550199123."), (101, "the version 5550199123x of the file"), (102, "lot 20240101 arrived")]
    plain = [(200 + k, f"{words(300 + k, 5)} lot {r.randrange(10**7, 10**8)} arrived") for k in range(30)]
    frame = spark.createDataFrame([*known, *unseen, *plain], "doc_id long, text string")
    got = {x.doc_id: x.spans for x in span_report(frame, scratch).collect()}
    assert got[100] == "found:22:32" and got[101] == "" and got[102] == ""
    assert all(got[k].startswith("phone:") and "found" not in got[k] for k, _ in known) and all(got[k] == "" for k, _ in plain)


def test_base_patterns_equal_the_plain_ones(spark, scratch):
    from loculus.llm.pii import KINDS, PATTERNS

    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    r = random.Random(8)
    texts = ["".join(r.choice("ab@@..-1234567890 +()_%é") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select(*[F.regexp_extract_all("t", F.lit(PATTERNS[k]), F.lit(0)).alias(k) for k in KINDS]).collect()
    for text, row in zip(texts, rows, strict=True):
        for k in KINDS:
            assert row[k] == re.findall(plain[k], text), (k, text)


def test_single_records_and_documents(spark, scratch):
    import public_tokenizers

    from loculus.llm.files import open_file
    from loculus.llm.idfiles import IdFile, write_id_files
    from loculus.llm.warc import read_record, write_archives

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    index = write_archives(pages, f"{scratch.path}/w", frame_bytes=5000).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    for entry in index[::7]:
        assert read_record(f"{scratch.path}/w", entry.file, entry.frame, entry.frame_offset)["payload"] == html[entry.page_id].encode()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    manifest = write_id_files(docs, f"{scratch.path}/i", public_tokenizers.path("word_bpe_49k.json"), 1, b"").collect()
    with open_file(f"{scratch.path}/i", manifest[0].file) as source:
        opened = IdFile(source, b"")
        assert opened.document(3)[-1] == 1 and len(opened.document(3)) == opened.index["ids"][3]
        with pytest.raises(ValueError, match="another dictionary"):
            IdFile(source, b"x")


def test_shards_are_balanced(spark, scratch):
    from loculus.llm.kdtree import kd_shards

    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("x"), (F.col("id") % 50 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 9).cast("string")).alias("source"),
        F.lit("en").alias("lang"),
    )
    sizes = [r[0] for r in kd_shards(docs, scratch, shards=7).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 200


def test_pipeline_decisions(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = p.quality_rules(spark, docs, SMALL)
    good = {r.doc_id for r in kept.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    clean = [d for d, q in labels.items() if q == 1 and len(texts[d].split()) >= 10]
    assert sum(d in good for d in clean) >= 0.95 * len(clean) and kept.columns == docs.columns
    single = p.near_duplicates(spark, kept, SMALL)
    left = {r.doc_id for r in single.collect()}

    def shingles(t):
        w = t.encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = {d: shingles(texts[d]) for d in good}
    ids = sorted(good)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    place = {d: k for k, d in enumerate(ids)}
    root = roots(len(ids), [(place[a], place[b]) for a, b in near])
    assert left == {d for d in ids if root[place[d]] == place[d]}
    masked = p.personal_data(spark, single, SMALL)
    assert not masked.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.[a-z]+")).count() and masked.count() == len(left)
    mixed = p.source_mix(spark, masked, SMALL)
    assert mixed.columns == docs.columns and mixed.count() > 0
    coded = p.token_ids(spark, mixed, SMALL)
    assert coded.count() == mixed.count() and coded.where("n_tokens = 0 or size(ids) <> n_tokens").count() == 0


def test_mix_is_the_same_however_rows_are_dealt(spark):
    """Many rows are equal; two, five and nine partitions give the same rows, and what is taken meets the target to a word."""
    from loculus.llm.common import Scratch
    from loculus.llm.mixing import mix

    rows = [(k % 7, words(k % 7, 23), "en", f"s{k % 7 % 3}", 0) for k in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = [sorted(map(tuple, mix(frame.repartition(n), Scratch(spark, "test")).collect())) for n in (2, 5, 9)]
    assert found[0] == found[1] == found[2]
    for source_size, target in {(r[2], r[3]) for r in found[0]}:
        assert sum(r[4] for r in found[0] if (r[2], r[3]) == (source_size, target)) == round(target)
