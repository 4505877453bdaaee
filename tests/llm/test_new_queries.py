"""Language-model scores, hard negatives and the conversation trie against plain restatements, on hostile rows and provided tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loculus.llm.common import Scratch
from tests.llm.conftest import words

SMALL = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def plain_base(docs):
    """(doc_id, held out, tokens, known, N, base score) by counting."""
    tokens = [(d, zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1, [*re.findall(r"[^\x20\x09-\x0D]+", lowered(t)), None]) for d, t in docs]
    counts = Counter(w for _, held, ws in tokens if not held for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for d, held, ws in tokens:
        score = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        yield d, held, len(ws), sum(counts[w] > 0 for w in ws), total, score


def check_scores(rows, docs):
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=key)
    want = sorted(((d, h, n, k, t, round(s, 6)) for d, h, n, k, t, s in plain_base(docs)), key=key)
    assert got == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)


def test_op11_base(spark, documents):
    from loculus.llm.lm import score_documents

    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    check_scores(score_documents(documents, Scratch(spark, "test")).collect(), docs)
    assert score_documents(documents.limit(0), Scratch(spark, "test")).count() == 0
    away = next(d for d in range(20) if zlib.crc32(str(d).encode()) % 5 == 1)
    unseen = documents.where(F.col("doc_id") == away)  # held out, and nothing to learn from
    check_scores(score_documents(unseen, Scratch(spark, "test")).collect(), [(away, r.text) for r in unseen.select("text").collect()])


def test_op11_predicts(spark):
    from loculus.llm.queries import op11_hashed_maxent

    at = "/root/testdata/sf0.01"
    rows = op11_hashed_maxent(spark, at).collect()
    check_scores(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()])
    held = [r for r in rows if r.held_out]
    gain = (sum(r.score for r in held) - sum(r.base_score for r in held)) / sum(r.n_tokens for r in held)
    assert gain > 0.25 and sum(r.score > r.base_score for r in held) > 0.9 * len(held)


def test_op11_is_a_distribution():
    """Over the end, every frequent word and the class of other words a context's probabilities add up to 1."""
    from loculus.llm.lm import RARE, SIGNS, Model

    r = np.random.default_rng(1)
    counts = np.zeros(RARE + 1)
    counts[:400] = r.zipf(1.3, 400) % 1000 + 1
    model = Model(counts, 500.0, r.integers(0, 9, (RARE + 1, SIGNS)).astype(float))
    model.weights += r.normal(size=model.weights.shape).astype(np.float32)
    model.head_weights += r.normal(size=model.head_weights.shape).astype(np.float32)
    context = [3, 17, 250]
    line = np.array([x for w in [*range(400), RARE] for x in (*context, w)])
    total = (10 ** model.scores(line, np.arange(3, len(line), 4))).sum()
    assert abs(total - 1) < 1e-4


def plain_negatives(rows):
    """(id, label, components) rows to results, by sorting all scores."""
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]
    for a, (anchor, label, v) in enumerate(rows):
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, u, strict=False)), i, lab) for b, (i, lab, u) in enumerate(rows) if b != a)
        for ps, p, _ in [x for x in scored if x[2] == label][:5]:
            inside = [(n, s) for s, n, lab in scored if lab != label and 80 * -ps <= 100 * -s <= 100 * -ps]
            for rank, (n, s) in enumerate(inside[:5], 1):
                yield anchor, p, rank, n, -ps, -s


def result(frame):
    return Counter(map(tuple, frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("seed", range(2))
def test_op12_small_blocks(spark, seed, monkeypatch):
    from loculus.llm import negatives

    monkeypatch.setattr(negatives, "BLOCK_ROWS", 37)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 3)
    r = random.Random(seed)
    rows = [(r.choice([k, 100 * (k % 7), 300]), k % 4, [r.gauss(0.1, 1) for _ in range(r.choice([70, 70, 9, 0]))]) for k in range(150)]
    rows += [(500 + k % 3, k % 2, [1.0] * 70) for k in range(40)]  # equal vectors, repeated ids
    rows += [(900, 1, [0.0] * 70), (1000, 1, [-1.0] * 70), (1001, 2, [1e9, 2.0]), (1100, 2, [1e9])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"row": F.lit(1), "block": F.lit(2), "anchor": F.lit(3)})
    odd = [(None, 1, [1.0]), (1200, None, [1.0]), (1200, 1, None), (1200, 1, [1.0, None]), (1200, 1, [float("nan")]), (1200, 1, [float("inf")])]
    frame = frame.unionByName(spark.createDataFrame(odd, "vec_id long, label int, embedding array<double>").withColumns({"row": F.lit(1), "block": F.lit(2), "anchor": F.lit(3)}))
    held = [(i, lab, [max(-(2.0**19), min(2.0**19, x)) for x in v]) for i, lab, v in rows]
    got = result(negatives.hard_negatives(frame.repartition(3), Scratch(spark, "test"), F.col("vec_id") % 100 == 0, wave_cells=1000))
    assert got == Counter(plain_negatives(held)) and got


def test_op12_empty(spark):
    from loculus.llm.negatives import hard_negatives

    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives(none, Scratch(spark, "test"), F.col("vec_id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives(alone, Scratch(spark, "test"), F.col("vec_id") % 100 == 0).count() == 0


def plain_trie(turns):
    """Nodes by grouping every prefix; turns are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple([*own.get(c - int(math.fmod(c, 20)), [])[:h], *mine[h:]])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in rebuilt.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        own_saved = (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += own_saved
    for p, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() if p in ends else hashlib.sha256(b"").hexdigest()
        yield min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(frame):
    return Counter(map(tuple, frame.select(*NODE).collect()))


def hostile_turns(seed):
    """Shared beginnings, copies, null and repeated turns, a long conversation, ids of either sign, clashing text."""
    r = random.Random(seed)
    pool = [("user", words(k, 3)) for k in range(4)] + [(None, None), ("", ""), ("user", None), ("a", "b c"), ("ab", " c")]
    rows = []
    for c in [*range(-30, 60), *range(400, 420)]:
        picks = [pool[r.randrange(len(pool)) if r.random() < 0.4 else 0] for _ in range(r.randrange(1, 9))]
        rows += [(c, None if k == 0 and c % 3 == 0 else k, *p) for k, p in enumerate(picks)]
    rows += [(c, k, "user", f"turn {k} of many") for c in (1000, 1020, 1021) for k in range(90)] + [(1021, 90, "user", "more")]
    rows += [(c, k, *pool[0]) for c in range(2000, 2100) for k in range(5)]  # copies
    rows += [(None, 1, "user", "nobody's"), (7, 100, "user", "twice"), (7, 100, "user", "twice")]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"run": 2, "block": 3, "fill": 2}])
def test_op13(spark, sizes):
    from loculus.llm.trie import prefix_trie

    rows = hostile_turns(len(sizes) + sum(sizes.values()))
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "pos", "i", "class", "length", "n", "head")})
    assert trie_rows(prefix_trie(frame.repartition(5), Scratch(spark, "test"), **sizes)) == Counter(plain_trie(rows))


def test_op13_small_and_empty(spark):
    from loculus.llm.queries import op13_cartesian_trie
    from loculus.llm.trie import prefix_trie

    schema = "conv_id long, turn int, role string, text string"
    assert prefix_trie(spark.createDataFrame([], schema), Scratch(spark, "test")).count() == 0
    for rows in ([(5, 1, "u", "one")], [(c, 1, "u", "same") for c in range(40)]):
        assert trie_rows(prefix_trie(spark.createDataFrame(rows, schema), Scratch(spark, "test"))) == Counter(plain_trie(rows))
    table = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert trie_rows(op13_cartesian_trie(spark, SMALL)) == Counter(plain_trie(table))


def test_nearest_smaller():
    from loculus.llm.trie import nearest_smaller

    r = np.random.default_rng(2)
    for n in (1, 2, 50, 300):
        v = r.integers(0, 6, n)
        left, right = nearest_smaller(v)
        for k in range(n):
            assert left[k] == max((j for j in range(k) if v[j] < v[k]), default=-1)
            assert right[k] == min((j for j in range(k + 1, n) if v[j] < v[k]), default=n)
