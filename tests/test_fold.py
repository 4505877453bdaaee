"""Search keys: the agreed cases, and tokens."""

import pytest
from pyspark.sql import functions as F

from loculus.functions import fold
from loculus.operators import search, tokens

#: (text, language, match key, loose key)
CASES = [
    (
        "μῆνιν",
        "grc",
        "μῆνιν",
        "μηνιν",
    ), ("Μῆνιν", "grc", "μῆνιν", "μηνιν"), ("δὲ", "grc", "δέ", "δε"), ("δέ", "grc", "δέ", "δε"), ("δ’", "grc", "δ'", "δ'"),
    ("δ᾽", "grc", "δ'", "δ'"), ("ΟΔΟΣ", "grc", "οδοσ", "οδοσ"), ("ὁδός", "grc", "ὁδόσ", "οδοσ"), (
        "Ἀχιλῆος",
        "grc",
        "ἀχιλῆοσ",
        "αχιληοσ",
    ), ("Ἄνδρα", "grc", "ἄνδρα", "ανδρα"),
    ("ὃν", "grc", "ὅν", "ον"), ("πρὸς", "grc", "πρόσ", "προσ"), (
        "virumque",
        "la",
        "uirumque",
        "uirumque",
    ), ("Juno", "la", "iuno", "iuno"), ("VENIT", "lat", "uenit", "uenit"),
    ("cōnsul", "la", "consul", "consul"), ("vir", "grc", "vir", "vir"), ("Été", "fr", "été", "ete"),
]


def test_keys(spark):
    rows = spark.createDataFrame(CASES, "t string, l string, m string, k string").select(
        fold.match_key(F.col("t"), F.col("l")).alias("m"),
        fold.loose_key(F.col("t"), F.col("l")).alias("k"),
    ).collect()
    assert [tuple(r) for r in rows] == [c[2:] for c in CASES]
    assert fold.fold_text(None, "grc", True) is None


@pytest.mark.parametrize(("text", "lang"), [("μῆνις", "grc"), ("arma", "la"), ("", "la"), ("ab ἀ", "grc")])
def test_guess(spark, text, lang):
    assert spark.range(1).select(fold.guess_language(F.lit(text))).first()[0] == lang


def test_tokens_and_context(spark):
    docs = spark.createDataFrame([(1, "Sing, «goddess» -- the wrath; the wrath."), (2, "  "), (3, None)], "doc_id long, text string")
    words = tokens.split_tokens(docs)
    assert [(r.pos, r.surface) for r in words.orderBy("pos").collect()] == [
        (1, "sing"),
        (2, "goddess"),
        (3, ""),
        (4, "the"),
        (5, "wrath"),
        (6, "the"),
        (7, "wrath"),
    ]
    occ = tokens.number_occurrences(words, ["doc_id"]).where("pos = 7").first()
    assert occ.occ == 2
    parts = search.context_parts(words, ["doc_id"])
    again = search.context_from_parts(words.where("pos = 4").select("doc_id", "pos"), parts, ["doc_id"], width=2).first()
    assert (again.before, again.after) == ("«goddess» --", "wrath; the")


def test_runs(spark):
    runs = spark.createDataFrame([(1, 0, 0, 11), (1, 1, 11, 20), (1, 2, 20, 25), (1, 3, None, None)], "d long, run long, start long, end long")
    words = spark.createDataFrame([(1, s, str(s)) for s in (17, 0, 12, 6, 15)], "d long, start_char long, token string")
    got = tokens.tokens_in_runs(runs, words, ["d"]).collect()
    assert sorted((r.run, r.token or "") for r in got) == [(0, "0"), (0, "6"), (1, "12"), (1, "15"), (1, "17"), (2, ""), (3, "")]


def test_labels(spark):
    rates = spark.createDataFrame([(12.4,), (3.456,), (0.0345,), (0.0,)], "r double")
    assert [r[0] for r in rates.select(search.rate_label(F.col("r"))).collect()] == ["12", "3.5", "0.035", "0"]
    assert [
        r[0] for r in spark.createDataFrame([("1",), ("4",), ("10",), ("a",)], "n string").select(tokens.labelled_lines(F.col("n"))).collect()
    ] == [True, False, True, False]


def test_prior_words(spark):
    texts = spark.createDataFrame([(1, "The, wrath -- the «the» end"), (2, None), (3, "none")], "d long, text string")
    got = tokens.prior_words(texts, F.lit("the")).orderBy("pos").collect()
    assert [(r.d, r.pos, r.prior) for r in got] == [(1, 1, None), (1, 3, "wrath"), (1, 4, "the")]
