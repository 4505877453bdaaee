"""Word search: counts by document, hits across works, words in context, and how results are named and ordered.

What is looked up lies in the stored index (``search_index``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.operators.tokens import spaced_tokens, token_array

#: Words that rates refer to, hits of a page, words on either side, tokens of a context part.
RATE_WORDS = 10_000
PAGE_HITS = 50
CONTEXT_WORDS = 10
PART_TOKENS = 32
TOKEN_SEPARATOR = "\u001f"


def counts_by_document(counts: DataFrame, wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, n, forms, n_words, rate) of documents with any of the forms or lemmas; ``rate`` per 10,000 words, 0 without words.

    ``counts`` (form or lemma, lang, doc_id, n) says what is counted; ``forms`` is the number of different ones in the document.
    """
    key = counts.columns[0]
    hits = counts.join(wanted.select(key, "lang").distinct(), [key, "lang"], "left_semi")
    counted = hits.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count_distinct(key).alias("forms"))
    rate = F.when(F.coalesce(F.col("n_words"), F.lit(0)) > 0, F.col("n") / F.col("n_words") * RATE_WORDS).otherwise(0.0)
    return counted.join(documents.select("doc_id", "n_words"), "doc_id").withColumn("rate", F.round(rate, 6))


def work_rank(by: str = "count") -> list[Column]:
    """Order of works by count or by rate, ties by the other and then by document."""
    keys = [F.desc("n"), F.desc("rate")]
    return [*(keys if by == "count" else keys[::-1]), F.asc("doc_id")]


def work_label(author: Column, title: Column, urn: Column) -> Column:
    """"Author, Title" with what there is; the urn stands for a missing title."""
    named = F.coalesce(F.nullif(title, F.lit("")), urn)
    return F.when(F.coalesce(author, F.lit("")) != "", F.concat_ws(", ", author, named)).otherwise(named)


def result_label(title: Column, language: Column, author: Column, editors: Column) -> Column:
    """"Title (language) — author — editors", empty parts left out."""
    more = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(" — "), c)).otherwise("") for c in (author, editors)]
    return F.concat(title, F.lit(" ("), F.coalesce(language, F.lit("")), F.lit(")"), *more)


def selected_works(works: DataFrame, doc_id: int | None) -> DataFrame:
    """Only the selected work; all works if there is no selection or the selected one isn't among the results."""
    if doc_id is None:
        return works
    there = works.where(F.col("doc_id") == doc_id).select(F.lit(True).alias("_there")).limit(1)
    marked = works.join(F.broadcast(there), how="left", on=F.lit(True))  # one row at most
    return marked.where(F.col("_there").isNull() | (F.col("doc_id") == doc_id)).drop("_there")


def rate_label(rate: Column) -> Column:
    """Whole numbers from 10 up, below that two significant digits without zeros at the end."""
    scale = F.pow(F.lit(10.0), 1 - F.floor(F.log10(rate)))
    small = F.round(rate * scale).cast("long") / scale
    return F.when(rate >= 10, F.round(rate).cast("long").cast("string")).when(
        rate > 0,
        F.regexp_replace(small.cast("string"), r"\.0$", ""),
    ).otherwise("0")


def fill_across_works(
    hits: Callable[[list[tuple[int, int]]], DataFrame],
    works: DataFrame,
    documents: DataFrame,
    first: int,
    count: int,
    most_works: int = 25,
) -> DataFrame:
    """Hits number ``first`` to ``first + count - 1`` through the best works in order, each in reading order.

    The best works are few, so their counts give every work its first number; ``hits`` is asked for the runs of
    chunks of the works that the page touches, and only these are numbered inside.
    """
    best = works.orderBy(*work_rank()).limit(most_works)
    order = Window.orderBy(*work_rank())
    placed = best.withColumns(
        {"work_rank": F.row_number().over(order), "_before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    )
    touched = placed.where((F.col("_before") < first + count) & (F.col("_before") + F.col("n") > first)).select("doc_id", "work_rank", "_before")
    spans = touched.join(documents.select("doc_id", "first_chunk", "last_chunk"), "doc_id").collect()  # ``most_works`` rows at most
    inside = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id", "seq"))
    known = touched.sparkSession.createDataFrame([(r.doc_id, r.work_rank, r["_before"]) for r in spans], "doc_id long, work_rank long, _before long")
    numbered = hits([(r.first_chunk, r.last_chunk) for r in spans]).join(known, "doc_id").withColumn("hit", F.col("_before") + inside - 1)
    return numbered.where(F.col("hit").between(first, first + count - 1)).drop("_before")


def context_in_texts(texts: DataFrame, is_hit: Callable[[Column], Column], width: int = CONTEXT_WORDS) -> DataFrame:
    """(doc_id, pos, token, before, after): tokens of ``texts`` (doc_id, text) that are hits, with the words before and after them.

    A text's tokens are at hand as an array, so hits are found and cut out in it and nothing is shuffled.
    """
    cut = texts.select("doc_id", token_array("text").alias("t"))
    places = F.filter(F.transform("t", lambda t, i: F.when(is_hit(t), i + 1)), lambda p: p.isNotNull())
    opened = cut.withColumn("p", F.explode(places))
    start = F.greatest(F.col("p") - width, F.lit(1))
    before, after = F.slice("t", start, F.col("p") - start), F.slice("t", F.col("p") + 1, F.lit(width))
    return opened.select(
        "doc_id",
        F.col("p").cast("long").alias("pos"),
        F.element_at("t", F.col("p")).alias("token"),
        F.array_join(before, " ").alias("before"),
        F.array_join(after, " ").alias("after"),
    )


def spaced_context(texts: DataFrame, is_hit: Callable[[Column], Column], width: int = CONTEXT_WORDS) -> DataFrame:
    """As ``context_in_texts``, from tokens that keep the blank behind them.

    What stands around a hit reads as in the text: the hit is trimmed, and the blank behind it begins what follows.
    """
    cut = texts.select("doc_id", spaced_tokens("text").alias("t"))
    places = F.filter(F.transform("t", lambda t, i: F.when(is_hit(F.rtrim(t)), i + 1)), lambda p: p.isNotNull())
    opened = cut.withColumn("p", F.explode(places)).withColumn("hit", F.element_at("t", F.col("p")))
    start = F.greatest(F.col("p") - width, F.lit(1))
    behind = F.array_join(F.slice("t", F.col("p") + 1, F.lit(width)), "")
    return opened.select(
        "doc_id",
        F.col("p").cast("long").alias("pos"),
        F.array_join(F.slice("t", start, F.col("p") - start), "").alias("before"),
        F.rtrim("hit").alias("hit"),
        F.concat(F.when(F.col("hit").endswith(" "), " ").otherwise(""), behind).alias("after"),
    )


def context_parts(tokens: DataFrame, chunk: list[str], pos: str = "pos") -> DataFrame:
    """Tokens of a chunk in numbered parts of 32, joined by the unit separator."""
    part = F.floor((F.col(pos) - 1) / PART_TOKENS).alias("part")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "token"))), lambda t: t["token"]), TOKEN_SEPARATOR)
    return tokens.groupBy(*chunk, part).agg(text.alias("tokens"))


def context_from_parts(hits: DataFrame, parts: DataFrame, chunk: list[str], width: int = CONTEXT_WORDS, pos: str = "pos") -> DataFrame:
    """``hits`` (chunk, pos) with token, before and after, from stored parts: only the parts around a hit are read."""
    first = F.floor(F.greatest(F.col(pos) - 1 - width, F.lit(0)) / PART_TOKENS)
    last = F.floor((F.col(pos) - 1 + width) / PART_TOKENS)
    wanted = hits.withColumn("_first", first).withColumn("part", F.explode(F.sequence("_first", last)))
    pieces = wanted.join(parts, [*chunk, "part"]).groupBy(*hits.columns, "_first").agg(
        F.array_sort(F.collect_list(F.struct("part", "tokens"))).alias("_p")
    )
    words = F.flatten(F.transform("_p", lambda p: F.split(p["tokens"], TOKEN_SEPARATOR)))
    at = (F.col(pos) - F.col("_first") * PART_TOKENS).cast("int")
    start = F.greatest(at - width, F.lit(1))
    around = {
        "token": F.element_at("_w", at),
        "before": F.array_join(F.slice("_w", start, at - start), " "),
        "after": F.array_join(F.slice(F.col("_w"), at + 1, F.lit(width)), " "),
    }
    return pieces.withColumn("_w", words).withColumns(around).select(*hits.columns, *around)


def describe_hits(hits: DataFrame, chunks: DataFrame, features: DataFrame) -> DataFrame:
    """Hits with the reference of their chunk and the part of speech and features of their reading; hits of forms have neither."""
    read = hits if "feat_id" in hits.columns else hits.withColumns({"lemma": F.lit(None).cast("string"), "feat_id": F.lit(None).cast("long")})
    return read.join(chunks.select("chunk_id", "ref"), "chunk_id", "left").join(features, "feat_id", "left").drop("feat_id")
