"""Overlaps by dyadic intervals against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from loculus.functions.citekey import ranges_overlap
from loculus.operators import overlap


def test_cover_is_exact_and_small(spark):
    r = random.Random(1)
    spans = [(a, a + r.choice([0, 1, 2, 7, 63, 1000, 10**6])) for a in (r.choice([0, 1, 5, 64, 999, 123_456]) for _ in range(60))]
    spans += [(1, 1_000_000), (0, 2**31 - 1)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", overlap.dyadic_cover(F.col("a"), F.col("b")).alias("c")).collect()
    for x in rows:
        parts = sorted((c.number << c.level, (c.number + 1) << c.level) for c in x.c)
        assert parts[0][0] == x.a and parts[-1][1] == x.b + 1 and all(p[1] == q[0] for p, q in zip(parts, parts[1:], strict=False))
        assert len(parts) <= max(1, 2 * (x.b - x.a + 1).bit_length())
    assert len(next(x.c for x in rows if (x.a, x.b) == (1, 1_000_000))) <= 40


@pytest.mark.parametrize("seed", range(2))
def test_overlaps_against_all_pairs(spark, seed):
    r = random.Random(seed)

    def citation():
        a = r.randrange(0, 40)
        b = a + r.choice([0, 0, 1, 5, 1000])
        low, high = r.choice([(f"{a}", f"{b}"), (f"{a}.{r.randrange(5)}", f"{b}.{r.randrange(5)}")])
        return low if r.random() < 0.3 else f"{low}-{high}" if r.random() < 0.9 else f"{high}-{low}"

    groups = ["u:g:a.w", "u:g:a.v"]
    passages = [(g := r.choice(groups), f"{g}.x", citation(), k) for k in range(80)] + [("u:g:a.w", "u:g:a.w.x", "1-1000000", 900)]
    entries = [(g := r.choice(groups), g, citation(), k) for k in range(80)] + [("u:g:a.w", "u:g:a.w", "1-1000000", 901), ("u:g:a.w", "u:g:a.w", None, 902)]
    left = spark.createDataFrame(passages, "group_key string, urn string, citation string, p int")
    right = spark.createDataFrame(entries, "group_key string, work_urn string, entry_citation string, e int")
    got = sorted((x.p, x.e) for x in overlap.entries_for_passages(left, right).select("p", "e").collect())
    every = left.crossJoin(right.withColumnRenamed("group_key", "g")).where((F.col("group_key") == F.col("g")) & ranges_overlap(F.col("entry_citation"), F.col("citation")))
    assert got == sorted((x.p, x.e) for x in every.select("p", "e").collect()) and len(got) == len(set(got)) > 100
