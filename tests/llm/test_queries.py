"""Every training-data query by its name, on hostile tables and on provided ones, against plain restatements of what it returns."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import sample_documents, words
from tests.llm.test_methods import roots

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hostile_documents():
    """The sample with digits, addresses, cards, octets over 255, astral letters before matches, and many equal rows."""
    texts = [
        "𝔸 é write ann.b@mail.example.org, or 10.0.0.256 and 10.0.0.255!",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4242424242424242.",
        "call +1 (555) 010-9999 or +12 34 or +1 555 010 9999 000 000 1",
        "a@b a@b.c a@@b.c x@y..z 1.2.3.4.5 001.002.003.004",
        'token = "a1b2c3d4e5f6a7b8c9d0e1f2" end',
        "dup line\ndup line\n\nother # $ line\ndup line\n" + "one two three four five six " * 4,
        "Straße ＦＵＬＬ don't   tabs\t\tand nbsp   <|endoftext|> 12345 ",
    ]
    rows = [(1000 + k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    return [*sample_documents(), *rows, *[(7777, words(5, 40), "en", "s1", 1)] * 30, *[(None, None, None, None, None)] * 5]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data folder with hostile documents, and columns whose names operators use inside."""
    at = str(tmp_path_factory.mktemp("hostile"))
    docs = spark.createDataFrame(hostile_documents(), "doc_id long, text string, lang string, source string, n_chars long")
    clashing = {
        c: F.lit("mine") for c in (
            "size",
            "key",
            "tie",
            "row",
            "spans",
            "doc",
            "copies",
            "target",
            "rest",
            "kept",
            "n_words",
            "keep_id",
            "label",
            "part",
            "short",
            "masked",
        )
    }
    docs.withColumns(clashing).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(d, d % 2, 0) for d, *_ in hostile_documents() if d is not None]
    spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def run(spark, folder, name):
    from loculus.llm.queries import queries

    found = {n.split("_")[0]: f for n, f in queries().items()}
    return found[name](spark, folder).collect()


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


BOTH = pytest.mark.parametrize("where", ["hostile", SMALL])


@pytest.fixture()
def table(where, folder):
    return folder if where == "hostile" else where


@BOTH
def test_op3(spark, table):
    def plain(text):
        w = WORD.findall(text or "")
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        seen, repeated = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                repeated += line in seen
                seen.add(line)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), repeated, len(covered), failed

    rows = run(spark, table, "op3")
    assert Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows
    ) == Counter((d, *plain(t)) for d, t in documents(spark, table))
    assert not any(r.kept and r.base_failed for r in rows) and any(r.kept for r in rows)


@BOTH
def test_op4(spark, table):
    data = [(d, (t or "").encode()) for d, t in documents(spark, table)]
    seen = Counter(b[i : i + 400] for _, b in data for i in range(len(b) - 399))
    want = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        cut = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], cut.astype(np.int8)])) == 1).sum())
        want.append((d, len(b), int(cut.sum()), runs, sha(np.frombuffer(b, np.uint8)[~cut].tobytes())))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, table, "op4")) == Counter(want)


@BOTH
def test_op5_and_op7(spark, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = documents(spark, table)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, table, "op5")) == want
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[(d, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))] += 1
    rows = sorted(run(spark, table, "op7"), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at, last = 0, -1
    for r in rows:
        assert r.start == at and last <= (-1 if r.doc_id is None else r.doc_id)
        at, last = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id


@BOTH
def test_op6(spark, table):
    rows = run(spark, table, "op6")
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in documents(spark, table))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        assert 0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) <= sum(sizes.values()) / 24 + 2 * max(r["size"] for r in rows)


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(digits[::-1])) % 10 == 0


@BOTH
def test_op8(spark, table):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
    }
    want = Counter()
    for d, t in documents(spark, table):
        spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok(m.group())] for k, (p, ok) in kinds.items()]
        want[(d, *map(len, spans), sha(",".join(x for s in spans for x in s)))] += 1
    rows = run(spark, table, "op8")
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
    for r in rows:
        base = [s for s in r.spans.split(",") if s and not s.startswith(("secret:", "found:"))]
        assert sha(",".join(base)) == r.base_sha256
        assert all(r[f"n_{kind}"] == sum(s.startswith(f"{kind}:") for s in r.spans.split(",")) for kind in ("secret", "found"))


def test_op8_secrets(spark):
    """The quoted values of the provided documents are marked as the seeds that they are; nothing else is found there."""
    rows = {r.doc_id: r for r in run(spark, "/root/testdata/sf0.01", "op8")}
    texts = dict(documents(spark, "/root/testdata/sf0.01"))
    secret = {d for d, t in texts.items() if re.search(r'token = "[0-9a-f]{24,}"', t or "")}
    assert secret and {d for d, r in rows.items() if r.n_secret} == secret and not any(r.n_found for r in rows.values())


def test_op8_contexts_that_were_cut_make_no_pattern(spark, scratch):
    """A token longer than a context isn't taken for the part of it that is kept, nor does a text begin behind a match."""
    from loculus.llm.pii import CONTEXT_CHARS, span_report

    long = "x" * (2 * CONTEXT_CHARS) + " reach "
    lines = [f"{long}+1 555 010 {1000 + k}" for k in range(8)] + [long[-CONTEXT_CHARS:] + "ab12cd34"]
    lines += [f"+1 555 020 {1000 + k} or +1 555 030 {2000 + k}" for k in range(8)] + ["or zz99yy88"]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert not any(r.n_found for r in span_report(frame, scratch).collect())
    lines = [f"please reach +1 555 010 {1000 + k}" for k in range(12)] + ["please reach ab12cd34"]
    from loculus.llm.common import Scratch

    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [r.doc_id for r in span_report(frame, Scratch(spark, "test")).collect() if r.n_found] == [12]


def test_op9_extreme(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()
    size = lambda t: len(WORD.findall(t or ""))
    rows = run(spark, folder, "op9")
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((d.doc_id, size(d.text)) for d in docs)
    totals = Counter()
    for d in docs:
        totals[d.source] += size(d.text)
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left = {}, 1.5 * sum(totals.values())
    while True:  # the excess of sources at their cap is shared again
        free = [s for s in names if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * totals[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            left -= target[s]
    for s in names:
        mine = [r for r in rows if abs(r.target - target[s]) < 1e-6 and r.source_size == totals[s]]
        assert mine and abs(sum(r.taken for r in mine) - target[s]) <= 40
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    again = run(spark, folder, "op9")
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


@BOTH
def test_op10(spark, table):
    def plain(text):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        if not w:
            return 0
        parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    docs = documents(spark, table)
    prints = {t: plain(t) for _, t in docs}
    values = sorted(set(prints.values()))
    fps = np.array(values, np.uint64)
    near = [(i, j) for i in range(len(fps)) for j in (np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3) + i + 1).tolist()]
    root = dict(zip(values, roots(len(values), near), strict=True))
    first = {}
    for d, t in docs:
        if d is not None:
            first[root[prints[t]]] = min(d, first.get(root[prints[t]], d))
    want = Counter((d, f"{prints[t]:016x}", first.get(root[prints[t]])) for d, t in docs)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in run(spark, table, "op10")) == want


def test_op1(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    from loculus.llm.warc import payload_digest

    first = {}
    for p in pages:
        first[p.html] = min(p.page_id, first.get(p.html, p.page_id))
    want = Counter(
        (
            p.page_id,
            len((p.html or "").encode()),
            payload_digest((p.html or "").encode()),
            *(("response", None) if first[p.html] == p.page_id else ("revisit", first[p.html])),
        ) for p in pages
    )
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in run(spark, SMALL, "op1")) == want


def test_op2(spark):
    at = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in table])
    data = np.array([r.embedding for r in table], float)
    rows, hit, asked = run(spark, at, "op2"), 0, [i for i in ids.tolist() if i % 100 == 0]
    for q in asked:
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        exact = np.sqrt(((data - data[ids == q][0]) ** 2).sum(axis=1))
        order = [int(ids[i]) for i in np.lexsort((ids, exact)) if ids[i] != q][:10]
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(abs(r.score - exact[ids == r.vec_id][0]) < 1e-9 for r in mine)
        hit += len({r.vec_id for r in mine} & set(order))
    assert hit >= 0.9 * 10 * len(asked)


def test_pipeline_on_hostile_documents(spark, folder):
    """``run`` as a whole: what stays, and that each stage's rows are as its operator says."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = p.run(spark, folder).collect()
    texts, source = defaultdict(list), {}
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
        source[r.doc_id] = r.source
    assert rows and all(len(WORD.findall(max(texts[r.doc_id], key=lambda t: len(t or "")) or "")) >= 10 for r in rows)
    assert all(r.n_tokens == len(r.ids) > 0 for r in rows)
    counts = Counter(r.doc_id for r in rows)
    assert max(counts.values()) <= 2 and counts[7777] <= 2  # thirty equal rows are one document
    assert not ({0, 20, 21} <= set(counts)) and len({0, 20, 21} & set(counts)) <= 1  # copies
    stage = docs
    for name, f in p.STAGES[:-1]:
        stage = f(spark, stage, folder)
        assert stage.columns == docs.columns, name
        kept = stage.collect()
        assert all(r["key"] == r["spans"] == r["doc"] == r["copies"] == "mine" for r in kept), name
        assert all(r.source == source[r.doc_id] for r in kept), name
        stage = spark.createDataFrame(kept, docs.schema)


def test_pipeline_without_labels(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(k, words(k, 50), "en", "s", 1) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.quality_rules(spark, docs, str(tmp_path)).count() == 20
    assert {r.doc_id for r in p.run(spark, str(tmp_path)).collect()} <= set(range(20))


def test_normal_forms_stay_apart(spark):
    from loculus.llm.bpe import encode
    from loculus.llm.queries import tokenizer_file

    pair = [(1, "é" * 30), (2, unicodedata.normalize("NFD", "é" * 30))]
    ids = {r.doc_id: tuple(r.ids) for r in encode(spark.createDataFrame(pair, "doc_id long, text string"), tokenizer_file("byte_bpe_50k.json")).collect()}
    assert ids[1] != ids[2]
