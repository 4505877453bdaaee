"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import sample_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SAMPLE = sample_documents()


def bag(rows):
    return Counter(map(tuple, rows))


def test_quality(documents, no_documents, spark):
    from loculus.llm.quality import judge, keep_good, text_statistics, train

    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rules = train(documents, labels)
    rows = judge(documents, rules).select("doc_id", "n_words", "n_repeat_words", "base_failed").collect()
    want = [(d, text_statistics(t)[0], text_statistics(t)[4]) for d, t, *_ in SAMPLE]
    assert bag((r[0], r[1], r[2]) for r in rows) == bag(want)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    kept = keep_good(documents, rules)
    assert kept.columns == documents.columns and kept.count() == sum(not r.base_failed for r in rows)
    assert train(documents, labels.limit(0)) == [] and judge(no_documents, []).count() == 0


def test_substrings(documents, no_documents, scratch):
    from loculus.llm.substrings import remove_repeats

    check_substrings(remove_repeats(documents, scratch).collect())
    assert remove_repeats(no_documents, scratch).count() == 0


def test_substrings_counted_by_spark(documents, scratch):
    from loculus.llm.substrings import remove_repeats

    check_substrings(remove_repeats(documents, scratch, most_together=1).collect())


def check_substrings(rows):
    data = [(d, (t or "").encode()) for d, t, *_ in SAMPLE]
    seen = Counter(b[i : i + 400] for _, b in data for i in range(len(b) - 399))
    want = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == bag(want)
    assert sum(w[2] for w in want) > 0


def test_bpe(documents, no_documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    from loculus.llm.bpe import decode, encode, round_trip

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = round_trip(documents, path).collect()
    want = [(d, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for d, t, *_ in SAMPLE]
    assert bag((r.doc_id, tuple(r.ids), r.decoded) for r in rows) == bag(want)
    assert bag(decode(encode(documents, path), path).collect()) == bag((d, t) for d, _, t in want)
    assert encode(no_documents, path).count() == 0


def test_kd_tree(documents, no_documents, scratch):
    from loculus.llm.kdtree import kd_shards

    rows = kd_shards(documents, scratch, shards=5).collect()
    want = [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in SAMPLE]
    assert bag((r.doc_id, r["size"], r.text_crc32) for r in rows) == bag(want)
    for k in range(5):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert kd_shards(no_documents, scratch, shards=5).count() == 0
    assert kd_shards(documents, scratch, target_bytes=1 << 30).select("shard").distinct().count() == 1


def test_id_files(documents, no_documents, scratch, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from loculus.llm.common import Scratch
    from loculus.llm.idfiles import id_file_round_trip

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = sorted(id_file_round_trip(documents, scratch, path).collect(), key=lambda r: r.start)
    want = sorted(((d is not None, d or 0, t or ""), d, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t, *_ in SAMPLE)
    at = 0
    for r, (_, d, ids) in zip(rows, want, strict=True):
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), crc)
        at += len(ids)
    assert id_file_round_trip(no_documents, Scratch(spark, "test"), path).count() == 0


def test_pii(documents, no_documents, scratch, spark):
    from loculus.llm.common import Scratch
    from loculus.llm.pii import mask_documents, span_report

    rows = span_report(documents, scratch).collect()
    found = {r.doc_id: r for r in rows if r.n_email}
    assert len(rows) == len(SAMPLE) and len(found) == 3 and all(r.n_phone == 1 for r in found.values())
    masked = mask_documents(documents, Scratch(spark, "test"))
    assert masked.columns == documents.columns
    texts = bag((r.doc_id, r.text) for r in masked.select("doc_id", "text").collect())
    want = bag((d, None if t is None else re.sub(r"\S+@\S+", "[EMAIL]", re.sub(r"\+1 .{14}", "[PHONE]", t))) for d, t, *_ in SAMPLE)
    assert texts == want
    assert span_report(no_documents, Scratch(spark, "test")).count() == 0 and mask_documents(no_documents, Scratch(spark, "test")).count() == 0


def test_mixing(documents, no_documents, scratch, spark):
    from loculus.llm.common import Scratch
    from loculus.llm.mixing import mix, mixed_documents

    rows = mix(documents, scratch).collect()
    want = [(d, len(WORD.findall(t or ""))) for d, t, *_ in SAMPLE]
    assert bag((r.doc_id, r["size"]) for r in rows) == bag(want)
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    for target in {r.target for r in rows}:
        assert abs(sum(r.taken for r in rows if r.target == target) - target) <= 4
    mixed = mixed_documents(documents, Scratch(spark, "test"))
    assert mixed.columns == documents.columns
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mix(no_documents, Scratch(spark, "test")).count() == 0 and mixed_documents(no_documents, Scratch(spark, "test")).count() == 0


def test_simhash(documents, no_documents, scratch, spark):
    from loculus.llm.common import Scratch
    from loculus.llm.simhash import fingerprint, near_duplicates

    rows = near_duplicates(documents, scratch).collect()
    prints = [(d, fingerprint(t)) for d, t, *_ in SAMPLE]
    group = {p: {p} for _, p in prints}
    for a in list(group):
        for b in list(group):
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[a]:
                    group[x] = group[a]
    first = {p: min((d for d, q in prints if q in group[p] and d is not None), default=None) for p in group}
    assert bag((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows) == bag((d, p, first[p]) for d, p in prints)
    assert near_duplicates(no_documents, Scratch(spark, "test")).count() == 0


def test_similar(documents, no_documents, scratch, spark):
    from loculus.llm.common import Scratch
    from loculus.llm.similar import keep_one_of_each

    kept = keep_one_of_each(documents, scratch)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and None not in ids  # the rows without an id are copies of others
    gone = {d for d, *_ in SAMPLE if d is not None} - set(ids)
    assert gone == {20, 21, 22, 24, 25, 28}  # copies, the edited copy, texts without words, the longer copy
    assert keep_one_of_each(no_documents, Scratch(spark, "test")).count() == 0


def test_warc(spark, scratch):
    from loculus.llm.warc import archive_round_trip, payload_digest

    pages = [
        (1, "http://a/x: y\n", "same"),
        (2, None, "same"),
        (3, "u", None),
        (4, "u", ""),
        (None, "u", "same"),
        (5, "é ü", "html é"),
        (1, "other", "same"),
        (None, None, "alone"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("frame", F.lit(2))
    rows = archive_round_trip(frame, scratch, frame_bytes=600, file_bytes=900).collect()
    want = []
    for i, _, html in pages:
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        revisit = bool(same) and i != min(same)
        data = (html or "").encode()
        want.append((i, len(data), payload_digest(data), "revisit" if revisit else "response", min(same) if revisit else None))
    assert bag((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == bag(want)
    assert archive_round_trip(frame.limit(0), scratch).count() == 0


def test_neighbours(spark, scratch):
    from loculus.llm.common import Scratch
    from loculus.llm.hnsw import nearest

    rows = [
        (0, [1.0, 0.0]),
        (100, [1.0, 0.0]),
        (1, [1.0, 0.5]),
        (2, [0.0, 0.0]),
        (3, None),
        (4, []),
        (5, [float("nan"), 1.0]),
        (6, [1.0, None]),
        (7, [float("inf"), 0.0]),
        (8, [1.0]),
        (None, [1.0, 0.0]),
        (9, [1.0, 0.0]),
        (100, [1.0, 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1))
    found = nearest(frame, scratch, F.pmod("vec_id", F.lit(100)) == 0, k=10).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in found if r.query_id == 0} == {(0, 1, 9), (0, 2, 100), (0, 3, 100), (0, 4, 1)}
    assert nearest(frame.limit(0), Scratch(spark, "test"), F.pmod("vec_id", F.lit(100)) == 0).count() == 0


@pytest.mark.parametrize("text", ["a" * 70_000, "1." * 30_000, "1 " * 30_000, "a@" + "b." * 30_000 + "c", "+1" + "2-" * 30_000])
def test_patterns_stay_linear(spark, scratch, text):
    from loculus.llm.pii import span_report

    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert span_report(frame, scratch).count() == 1
