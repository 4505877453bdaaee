"""What is found must be all there is: planted groups against brute force."""

import random

import numpy as np
import pytest

from tests.llm.conftest import words
from tests.llm.test_methods import roots


def shingles(text):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def check_groups(spark, scratch, texts):
    """The stage's groups are those of all pairs; returns the number of groups."""
    from loculus.llm.similar import similar_groups

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.group for r in similar_groups(frame, scratch).collect()}
    sets = [shingles(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want, first = roots(len(texts), near), {}
    assert [first.setdefault(got[k], k) for k in range(len(texts))] == [want[k] for k in range(len(texts))]
    return len(first)


def test_large_groups_of_variants(spark, scratch):
    r, text = random.Random(3), words(1, 100).split()
    texts = []
    for k in range(1200):
        mine = list(text)
        for n, at in enumerate(r.sample(range(100), 2)):
            mine[at] = f"new{k}x{n}"
        texts.append(" ".join(mine))
    assert check_groups(spark, scratch, texts) > 1


def test_one_radius_at_every_group_size():
    from loculus.llm.simhash import FOREST_BLOCK, forest

    r = np.random.default_rng(11)
    fps = np.unique(r.integers(0, 1 << 32, 2600, dtype=np.uint64))
    fps = np.unique(np.concatenate([fps, fps[:600] ^ np.uint64(0b1010101010101)]))
    assert len(fps) > FOREST_BLOCK
    for most in (5, 7, 10):
        near = [(i, j) for i in range(len(fps)) for j in (np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= most) + i + 1).tolist()]
        place = {int(f): i for i, f in enumerate(fps)}
        links = np.concatenate(forest(fps, list(range(33)), most))
        assert (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= most).all()
        assert roots(len(fps), near) == roots(len(fps), [(place[int(a)], place[int(b)]) for a, b in links])


def test_contiguous_edits(spark, scratch):
    texts = []
    for k in range(60):
        base, new = words(1000 + k, 400).split(), words(5000 + k, 90).split()
        appended, cut = base + new[: 78 + k % 24], base[: 320 + k % 6]
        tail = base[: 353 + k % 8] + new[: 47 - k % 8]
        block = base[:150] + new[: 38 + k % 6] + base[188 + k % 6 :]
        # one kind of edit for each text, so no copy is joined through another
        texts += [" ".join(base), " ".join((appended, cut, tail, block)[k % 4])]
    check_groups(spark, scratch, texts)


def test_texts_with_the_same_words(spark, scratch):
    r, texts = random.Random(9), []
    for k in range(12):
        parts = [words(100 * k + n, 40) for n in range(8)]
        for _ in range(8):  # each order of the parts comes with a near copy that has the same set of words
            r.shuffle(parts)
            moved = parts[0].split()
            texts += ["\n".join(parts), "\n".join([" ".join(moved[5:] + moved[:5]), *parts[1:]])]
    assert check_groups(spark, scratch, texts) < len(texts)


def test_patterns_learned_from_promoted_values(spark, scratch):
    from loculus.llm.pii import span_report

    known = [f"{words(k, 5)} reach desk via +1 (555) 010-{1000 + k} today" for k in range(100)]
    numbers = [f"{5550199100 + k}" for k in range(10)]
    first = [f"{words(200 + k, 5)} reach desk via {n} today" for k, n in enumerate(numbers)]
    second = [f"{words(300 + k, 5)} ring extension {n} today" for k, n in enumerate(numbers)]
    last = ["please ring extension 7770199555 today", "the lot 7770199556 arrived"]
    frame = spark.createDataFrame(list(enumerate([*known, *first, *second, *last])), "doc_id long, text string")
    got = {x.doc_id: x.spans for x in span_report(frame, scratch).collect()}
    assert got[120] == "found:22:32" and got[121] == ""


def variants(seed, n, size, edits):
    """``n`` texts of ``size`` words, each with some words of its own in place of the first one's."""
    r, text = random.Random(seed), words(seed, size).split()
    out = []
    for k in range(n):
        mine = list(text)
        for j, at in enumerate(r.sample(range(size), r.randint(*edits))):
            mine[at] = f"new{k}x{j}"
        out.append(mine)
    return text, out


def test_five_thousand_near_copies(spark, scratch):
    from loculus.llm.similar import similar_groups

    text, texts = variants(21, 5000, 150, (1, 6))
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.group for r in similar_groups(frame, scratch).collect()}
    # words put in are all different, so two texts share the shingles that neither has lost
    kept = np.array([[t[i : i + 5] == text[i : i + 5] for i in range(146)] for t in texts])
    common = kept.astype(np.float32) @ kept.T.astype(np.float32)
    linked, want, first = common >= 0.8 * (292 - common), np.full(5000, -1), {}
    for k in range(5000):
        front = np.array([k]) if want[k] < 0 else np.empty(0, int)
        while len(front):
            want[front] = k
            front = np.flatnonzero(linked[front].any(axis=0) & (want < 0))
    assert [first.setdefault(got[k], k) for k in range(5000)] == [want[k] for k in range(5000)]
    assert 1 < len(first) < 5000


def test_salted_shingles(spark, scratch, monkeypatch):
    from loculus.llm import similar

    monkeypatch.setattr(similar, "SALT_TEXTS", 16)
    monkeypatch.setattr(similar, "PAIRED_GROUP", 4)
    _, texts = variants(22, 300, 120, (1, 5))
    assert 1 < check_groups(spark, scratch, [" ".join(t) for t in texts]) < 300


def test_open_groups_fetch_only_texts_that_may_link(spark, monkeypatch):
    """A passage that otherwise different texts share makes large groups; bitmaps settle these, and no whole sets are needed for them."""
    from loculus.llm import similar
    from loculus.llm.common import Scratch

    monkeypatch.setattr(similar, "PAIRED_GROUP", 4)
    monkeypatch.setattr(similar, "COMMON_SHINGLES", 0)  # else the passage is not in the prefixes of so few texts
    r = random.Random(23)
    passage = [f"shared{k}" for k in range(120)]
    apart = [" ".join([f"w{r.randrange(10**9)}" for _ in range(200)] + passage) for _ in range(90)]
    _, near = variants(24, 90, 120, (1, 5))
    rows = {}

    class Counted(Scratch):
        def table(self, df, name):
            stored = super().table(df, name)
            rows[name] = stored.count()
            return stored

    assert 90 < check_groups(spark, Counted(spark, "test"), apart + [" ".join(t) for t in near]) < 180
    assert rows["several"] > 0
    assert rows.get("open-shingles", 0) <= 90


def test_possible_partners_are_those_of_may_link(monkeypatch):
    from loculus.llm import similar

    monkeypatch.setattr(similar, "_CELLS", 64)  # many steps
    r = np.random.default_rng(7)
    base = r.integers(-(1 << 63), (1 << 63) - 1, 700)
    sets = []
    for _ in range(120):
        cut, more = int(r.integers(0, 500)), int(r.integers(0, 60))
        sets.append(np.unique(np.concatenate([base[cut : cut + int(r.integers(50, 700))], r.integers(-(1 << 63), (1 << 63) - 1, more)])))
    sizes, maps, labels = np.array([len(s) for s in sets]), [similar.parity_bitmap(s) for s in sets], r.integers(0, 40, 120)
    probes, others = np.arange(0, 60), np.arange(40, 120)
    want = np.zeros(120, bool)
    for u in probes.tolist():
        for v in others.tolist():
            if labels[u] != labels[v] and similar.may_link(sizes[[u]], sizes[[v]], [maps[u]], [maps[v]], 0.8)[0]:
                want[[u, v]] = True
    assert similar.possible_partners(sizes, maps, labels, probes, others, 0.8).tolist() == want.tolist()
    assert 0 < want.sum() < 120


def test_lookups_meet_few_other_texts(spark):
    from pyspark.sql import functions as F

    from loculus.llm.similar import likely

    keyed = spark.range(20_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("text_hash"))
    chosen = keyed.where("doc_id % 100 = 3").select(F.col("text_hash").alias("of_hash"))
    got = {r.doc_id for r in likely(keyed, chosen).collect()}
    assert set(range(3, 20_000, 100)) <= got
    assert len(got) < 210
    assert likely(keyed, chosen.limit(0)).count() == 0


@pytest.mark.parametrize("most_together", [16, 300])
def test_split_signatures(spark, scratch, most_together):
    from loculus.llm.simhash import signature_links

    r = np.random.default_rng(5)
    bits = r.integers(0, 64, (2500, 4)) % np.array([64, 20, 20, 20])
    fps = np.unique(np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64), axis=1))
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = np.array([(x.a, x.b) for x in signature_links(frame, scratch, most_together=most_together).collect()], np.int64).view(np.uint64)
    assert (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= 3).all()
    near = [(i, j) for i in range(len(fps)) for j in (np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3) + i + 1).tolist()]
    place = {int(f): i for i, f in enumerate(fps)}
    assert roots(len(fps), near) == roots(len(fps), [(place[int(a)], place[int(b)]) for a, b in links])


def test_bitmaps_lose_no_pair():
    from loculus.llm.similar import may_link, parity_bitmap

    r = np.random.default_rng(6)
    for _ in range(300):
        base = r.integers(-(1 << 63), (1 << 63) - 1, int(r.integers(1, 900)))
        other = np.concatenate([base[int(r.integers(0, max(1, len(base) // 5))) :], r.integers(-(1 << 63), (1 << 63) - 1, int(r.integers(0, len(base) // 6 + 2)))])
        a, b = np.unique(base), np.unique(other)
        common = len(np.intersect1d(a, b))
        if common >= 0.8 * (len(a) + len(b) - common):
            assert may_link(np.array([len(a)]), np.array([len(b)]), [parity_bitmap(a)], [parity_bitmap(b)], 0.8)[0]
    far = r.integers(-(1 << 63), (1 << 63) - 1, (2, 600))
    assert not may_link(np.array([600]), np.array([600]), [parity_bitmap(far[0])], [parity_bitmap(far[1])], 0.8)[0]


def test_refinement_equals_brute_force():
    from collections import Counter

    from loculus.llm.suffixes import repeated_strings

    r = random.Random(4)
    bases = [bytes(r.choices(b"abcdef ", k=900)) for _ in range(5)]
    pieces = []
    for _ in range(80):
        b = bytearray(r.choice(bases))
        for _ in range(r.randint(0, 2)):
            b[r.randrange(900)] = 120
        a = r.randrange(300)
        pieces.append(bytes(b[a : a + r.randint(400, 600)]))
    pieces += [b"a" * 700, b"ab" * 350]
    sizes = np.array([len(p) for p in pieces])
    seen = Counter(p[i : i + 400] for p in pieces for i in range(len(p) - 399))
    begins = np.cumsum(sizes) - sizes
    want = [int(s) + i for p, s in zip(pieces, begins, strict=True) for i in range(len(p) - 399) if seen[p[i : i + 400]] > 1]
    assert repeated_strings(np.frombuffer(b"".join(pieces), np.uint8), sizes).tolist() == want and 0 < len(want) < sum(sizes - 399)


def test_a_second_attempt_replaces_a_file(tmp_path, monkeypatch):
    """As on stores that refuse to move onto an existing name."""
    from pyarrow import fs

    from loculus.llm import files

    class Strict:
        def __init__(self):
            self.inner = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def move(self, source, target):
            if self.inner.get_file_info(target).type != fs.FileType.NotFound:
                raise FileExistsError(target)
            self.inner.move(source, target)

    monkeypatch.setattr(files, "resolve", lambda uri: (Strict(), uri))
    for attempt in (b"first", b"again"):
        with files.new_file(str(tmp_path), "x") as out:
            out.write(attempt)
    assert (tmp_path / "x").read_bytes() == b"again" and [p.name for p in tmp_path.iterdir()] == ["x"]
