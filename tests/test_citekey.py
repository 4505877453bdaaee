"""Citation keys and identifiers: given cases, and agreement with plain Python on random passages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loculus.functions import citekey as K
from loculus.functions import urn as U


def evaluate(spark, rows, schema, **columns):
    frame = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in frame.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def python_key(part):
    return [int(m.group()) if (m := re.match("[0-9]+", c)) else 0 for c in part.split(".")]


CASES = [("urn:x:1-93", [1], [93]), ("49", [49], [49]), ("1.1", [1, 1], [1, 1]), ("1a", [1], [1]), ("pr", [0], [0]), ("1.2-1.9-2", [1, 2], [1, 9])]


def test_given_keys(spark):
    got = evaluate(spark, [(c[0],) for c in CASES], "c string", s=K.start_key(F.col("c")), e=K.end_key(F.col("c")))
    assert got == [(s, e) for _, s, e in CASES]
    assert evaluate(spark, [("a1.x2b",)], "c string", t=K.typed_key(F.col("c")), s=K.start_key(F.col("c"))) == [([1, 2], [0, 0])]


def test_random_keys_agree_with_python_and_keep_order(spark):
    r = random.Random(5)
    some = ["".join(r.choice("0123456789.-ab") for _ in range(r.randint(1, 8))) for _ in range(300)]
    got = evaluate(spark, [(s,) for s in some], "c string", s=K.start_key(F.col("c")), e=K.end_key(F.col("c")), o=K.sortable(K.start_key(F.col("c"))))
    for text, (start, end, shown) in zip(some, got, strict=True):
        assert start == python_key(text.split("-", 1)[0]) and end == python_key(text.split("-", 1)[-1]), text
        assert shown.count(".") == len(start) - 1
    assert [s for s, _, _ in sorted(got, key=lambda x: x[2])] == sorted(s for s, _, _ in got)


@pytest.mark.parametrize(("a", "b", "want"), [([1], [1, 5], [0, 5]), ([1, 50, 9], [1, 51], [0, 1, 9]), ([2], [9], [7])])
def test_distance(spark, a, b, want):
    assert evaluate(spark, [(a, b)], "a array<bigint>, b array<bigint>", d=K.distance(F.col("a"), F.col("b"))) == [(want,)]


def test_leaf_range_and_overlap(spark):
    starts = [[4], [5, 1], [5, 2], [5, 3], [6]]
    got = evaluate(
        spark,
        [(s,) for s in starts],
        "s array<bigint>",
        w=K.starts_within(F.col("s"), F.array(F.lit(5).cast("long")), F.array(F.lit(5).cast("long"))),
    )
    assert [w for (w,) in got] == [False, True, True, True, False]
    pairs = [("1-93", "90-100", True), ("1.1-1.9", "2", False), ("5", "5.3", True), ("3", "1-2", False)]
    got = evaluate(
        spark,
        pairs,
        "a string, b string, w boolean",
        o=K.ranges_overlap(F.col("a"), F.col("b")),
        p=K.ranges_overlap(F.col("b"), F.col("a")),
    )
    assert got == [(w, w) for _, _, w in pairs]


def test_qualify_and_targets(spark):
    rows = [("7", "1.51", "1.7"), ("94-140", "49", "94-140"), ("3-4", "2.1", "2.3-2.4"), ("1.2.3", "1.2", "1.2.3")]
    assert evaluate(spark, rows, "v string, c string, w string", q=K.qualify(F.col("v"), F.col("c"))) == [(w,) for *_, w in rows]
    rows = [
        ("urn:cts:l:a.b:1", "urn:cts:l:a.b", "1"),
        ("urn:cts:l:a.c:1", "urn:cts:l:a.b", None),
        ("12", "urn:cts:l:a.b", None),
        ("urn:cts:l:a:3", "urn:cts:l:a.b", "3"),
    ]
    assert evaluate(spark, rows, "v string, w string, x string", q=K.target_citation(F.col("v"), F.col("w"))) == [(x,) for *_, x in rows]


def test_typed_scope(spark):
    rows = [("5.4", "5.4"), (" 100a. ", "100a"), ("5.4-6", "5.4"), ("5–7", "5"), ("x", None), ("", None), ("5.4;,", "5.4")]
    assert evaluate(spark, rows, "t string, w string", s=K.typed_scope(F.col("t"))) == [(w,) for _, w in rows]


def test_urns(spark):
    rows = [
        ("urn:cts:greekLit:a.b.c", True),
        ("urn:cts:greekLit:a.b.c:1.2", True),
        ("urn:cts:greekLit:a.b", False),
        ("urn:x:greekLit:a.b.c", False),
        (None, False),
        ("a.b.c", False),
    ]
    assert evaluate(spark, rows, "u string, w boolean", v=U.is_version_urn(F.col("u"))) == [(w,) for _, w in rows]
    rows = [
        ("urn:cts:g:a.b.c:57", "urn:cts:g:a.b", "g/a/b/c", "a.b.c"),
        ("urn:cts:g:a.b", "urn:cts:g:a.b", "g/a/b", "a.b"),
        ("x.y", "x.y", "x_y", "x.y"),
    ]
    got = evaluate(spark, rows, "u string, w string, p string, v string", w=U.work_urn(F.col("u")), p=U.path(F.col("u")), v=U.version_id(F.col("u")))
    assert got == [tuple(r[1:]) for r in rows]
    rows = [("urn:cts:g:a.b.c:2", "urn:cts:g:a.b"), ("urn:cts:g:a", None), ("a.b", None), (None, None)]
    assert evaluate(spark, rows, "u string, w string", a=U.about_work(F.col("u"), F.lit(None).cast("string"))) == [(w,) for _, w in rows]
    rows = [("pub-grc2", "pub-grc", 2), ("pub", "pub", 0), ("1st-grc10", "1st-grc", 10)]
    family, number = U.family(F.col("v"))
    assert evaluate(spark, rows, "v string, f string, n long", f=family, n=number) == [(f, n) for _, f, n in rows]
    rows = [("CTS", ""), ("CTS-Card", "card"), ("CTS-", "cts-"), ("10.b.xml", None)]
    assert evaluate(spark, rows[:3], "s string, w string", s=U.scheme_slug(F.col("s"))) == [(w,) for _, w in rows[:3]]
    assert evaluate(spark, [("d/10.b.xml",)], "s string", s=U.sidecar_name(F.col("s"))) == [("d/10.b.tokens.json.zst",)]
