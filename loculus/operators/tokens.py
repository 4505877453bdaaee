"""Tokens: cutting texts, numbering occurrences, and laying tokens into text runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.functions.fold import bare_word, is_punctuation

#: Fields of a token that pages need.
TOKEN_FIELDS = ("text", "urn", "whitespace", "start_char", "end_char")


def token_array(text: str) -> Column:
    """The runs of non-blank characters of a text, in order; none for a blank or null one."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda t: t != "")


def spaced_tokens(text: str) -> Column:
    """Words and single signs of a text in order, each with the blank behind it if there is one (other white space counts as a blank)."""
    blanks = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t-\r]+", " ")
    return F.regexp_extract_all(blanks, F.lit(r"((?:[\p{L}\p{M}\p{N}]+|[^ \p{L}\p{M}\p{N}]) ?)"), F.lit(1))


def bare_surface(token: Column) -> Column:
    """Lower case, without punctuation and symbols at the ends; tokens of letters need no pattern."""
    return F.lower(F.when(token.rlike(r"^\p{L}(?:.*\p{L})?$"), token).otherwise(bare_word(token)))


def split_tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per run of non-blank characters: ``pos`` from 1, ``token``, ``surface`` (lower case, bare); blank texts give none."""
    cut = texts.withColumn("_t", token_array(text)).drop(text)
    opened = cut.select("*", F.posexplode("_t").alias("_p", "token")).withColumn("pos", (F.col("_p") + 1).cast("long")).drop("_t", "_p")
    return opened.withColumn("surface", bare_surface(F.col("token")))


def number_occurrences(tokens: DataFrame, chunk: list[str], form: str = "surface", pos: str = "pos") -> DataFrame:
    """``occ``: which occurrence of its form in its chunk a token is."""
    return tokens.withColumn("occ", F.row_number().over(Window.partitionBy(*chunk, form).orderBy(pos)))


def prior_words(texts: DataFrame, word: Column, text: str = "text") -> DataFrame:
    """``texts``' other columns with ``pos`` and ``prior`` of every ``word`` in a text: its place among the words, and the word before it.

    Tokens that are nothing but punctuation don't count; the first word has none before it.  A text's words are at hand
    as an array, so nothing is sorted or shuffled.
    """
    words = F.filter(F.transform(token_array(text), bare_surface), lambda w: w != "")
    cut = texts.withColumn("_w", words).drop(text)
    found = F.filter(F.transform("_w", lambda w, i: F.when(w == word, i)), lambda i: i.isNotNull())
    opened = cut.withColumn("_i", F.explode(found))
    return opened.withColumns({"pos": (F.col("_i") + 1).cast("long"), "prior": F.when(F.col("_i") > 0, F.get("_w", F.col("_i") - 1))}).drop("_w", "_i")


def tokens_in_runs(runs: DataFrame, tokens: DataFrame, by: list[str], bucket: int = 64) -> DataFrame:
    """Runs (run, start, end) with the tokens that start in them (``start_char``); runs without any, or without offsets, stay alone.

    Runs are listed under the character buckets that they cross and tokens
    under their own, so the join is by equality and linear in its result.
    """
    listed = runs.where("start is not null and end is not null and start < end").withColumn(
        "_b",
        F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))),
    )
    placed = tokens.withColumn("_b", F.floor(F.col("start_char") / bucket))
    held = listed.join(placed, [*by, "_b"]).where("start <= start_char and start_char < end").drop("_b")
    alone = runs.join(held.select(*by, "run").distinct(), [*by, "run"], "left_anti")
    return held.unionByName(alone, allowMissingColumns=True)


def with_token_urns(tokens: DataFrame, chunk_urn: Column, occurrence: str = "occ") -> DataFrame:
    """``tokens`` (token, surface) with ``urn``: the chunk's with form and occurrence; null for tokens that are nothing but punctuation."""
    named = F.concat(chunk_urn, F.lit("@"), F.col("surface"), F.lit("["), F.col(occurrence).cast("string"), F.lit("]"))
    return tokens.withColumn("urn", F.when(~is_punctuation(F.col("token")), named))


def priority_content(*choices: Column) -> Column:
    """Of several places for one file the content of the first that exists."""
    return F.coalesce(*choices)


def labelled_lines(n: Column) -> Column:
    """Lines whose number is shown: the first and every fifth."""
    number = n.try_cast("int")
    return F.coalesce((number == 1) | (F.pmod(number, F.lit(5)) == 0), F.lit(False))
