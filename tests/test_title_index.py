"""Fuzzy titles against scoring every entry."""

import random

import pytest
from pyspark.sql import functions as F

from loculus.operators import title_index


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(rows, query, threshold, limit=50):
    out = []
    for title, author, editors, url in rows:
        score = lambda c: 1.0 if c is None else 0.0 if query.lower() in c.lower() else edits(c.lower(), query.lower()) / max(len(c), len(query), 1)
        best = round(min(map(score, (title, author, editors))), 6)
        if best <= threshold:
            out.append((best, title or "", url))
    return sorted(out)[:limit]


def sample(seed=5):
    r = random.Random(seed)
    word = lambda n: "".join(r.choices("abcde ", k=n))
    rows = [(word(r.choice([3, 8, 12, 20])), r.choice(["Homer", "Vergil", "Ovid", None, ""]), word(4), f"u{k}") for k in range(300)]
    rows += [("Iliad", "Homer", "", "u1000"), ("The Odyssey", "Homer", "Murray", "u1001"), (None, None, None, "u1002"), ("a" * 300, "x", "", "u1003")]
    return rows


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = sample()
    frame = spark.createDataFrame(rows, "title string, author string, editors string, url string").repartition(3)
    return rows, title_index.open_title_index(spark, title_index.write_title_index(frame, str(tmp_path_factory.mktemp("titles"))))


@pytest.mark.parametrize("query", ["Odysey", "iliad", "Hommer", "abcd", "ab", "e", "", "a" * 295, "abcdeabcdeab", "nothing like it"])
@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5])
def test_as_if_all_were_scored(built, query, threshold):
    rows, index = built
    got = [(r.score, r.title or "", r.url) for r in title_index.fuzzy_titles(index, query, threshold).collect()]
    assert got == plain(rows, query, threshold)


def test_only_candidates_are_scored(built):
    rows, index = built
    for query, most in (("Odysey", 5), ("the odissey", 5), ("Hommer", 100)):
        assert title_index.candidates(index, query).count() <= most
    assert title_index.candidates(index, "").count() == len(rows)
    assert title_index.candidates(index, "xyzzy").count() == 0


def test_sequences_are_long_enough_to_tell():
    assert title_index.gram_size(10, 0.3) == 2 and title_index.gram_size(10, 0.0) == 3 and title_index.gram_size(10, 0.75) == 1
    assert title_index.gram_size(1, 0.3) == 1 and title_index.gram_size(0, 0.3) is None and title_index.gram_size(5, 1.0) is None


def test_unfinished_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="404"):
        title_index.open_title_index(spark, str(tmp_path))
    none = spark.createDataFrame([], "title string, author string, editors string, url string")
    index = title_index.open_title_index(spark, title_index.write_title_index(none, str(tmp_path)))
    assert title_index.fuzzy_titles(index, "any").count() == 0 and index.grams.where(F.col("gram") == "a").count() == 0
