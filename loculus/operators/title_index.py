"""Fuzzy search of titles, authors and editors over a stored index of letter sequences.

Two texts that are few edits apart share many short sequences of letters: each
edit can break at most q sequences of q letters.  The index lists, by sequence,
the fields that hold it; a lookup reads the lists of the query's sequences only,
counts what each field shares with it, and scores just the entries that share
enough.  The longest sequences are used for which "enough" is at least one.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loculus.session import file_status

#: Fields that are searched, the largest distance of a hit, hits of an answer.
FIELDS = ("title", "author", "editors")
THRESHOLD, MOST_HITS = 0.3, 50
#: Lengths of the sequences that are indexed.
SIZES = (1, 2, 3)


@dataclass(frozen=True)
class TitleIndex:
    """entries (entry, and the columns given), grams (gram, entry, field, shown_length, length, n)."""

    entries: DataFrame
    grams: DataFrame


def write_title_index(entries: DataFrame, root: str) -> str:
    """Index ``entries`` (title, author, editors, url, ...) below ``root`` and return the folder; a marker is written last."""
    spark, folder = entries.sparkSession, f"{root}/{uuid.uuid4().hex}"
    entries.withColumn("entry", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{folder}/entries")
    kept = spark.read.parquet(f"{folder}/entries")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("shown"), F.lower(F.col(c)).alias("text")) for c in FIELDS])
    opened = kept.select("entry", F.explode(fields).alias("f")).select("entry", "f.*").where("text <> ''")
    size = F.length("text")
    cut = lambda q: F.when(size >= q, F.transform(F.sequence(F.lit(1), size - (q - 1)), lambda at: F.substr(F.col("text"), at, F.lit(q))))
    grams = F.flatten(F.array(*[F.coalesce(cut(q), F.array().cast("array<string>")) for q in SIZES]))
    listed = opened.select("entry", "field", F.length("shown").alias("shown_length"), size.alias("length"), F.explode(grams).alias("gram"))
    counted = listed.groupBy("gram", "entry", "field", "shown_length", "length").agg(F.count("*").alias("n"))
    counted.repartitionByRange("gram", "entry").sortWithinPartitions("gram", "entry").write.option("compression", "zstd").parquet(f"{folder}/grams")
    spark.createDataFrame([(json.dumps({"fields": FIELDS, "sizes": SIZES}),)], "value string").coalesce(1).write.text(f"{folder}/manifest.json")
    return folder


def open_title_index(spark: SparkSession, folder: str) -> TitleIndex:
    """The index in a folder; an error where none was finished."""
    if file_status(spark, f"{folder}/manifest.json") is None:
        raise FileNotFoundError(f"404: no title index at {folder}")
    return TitleIndex(spark.read.parquet(f"{folder}/entries"), spark.read.parquet(f"{folder}/grams"))


def gram_size(length: int, threshold: float) -> int | None:
    """The longest sequences by which every hit of a query of so many letters shares one at least; None if none does."""
    if threshold >= 1:
        return None
    longest = math.ceil(length / (1 - threshold)) + 1  # a hit is no longer than that, or holds the query
    enough = lambda q: all(m - q + 1 - q * math.floor((threshold + 1e-6) * m) >= 1 for m in range(length, longest + 1))
    return max((q for q in SIZES if q <= length and enough(q)), default=None)


def field_score(field: str, query: str) -> Column:
    """Edit distance over the longer length, 0 where the field holds the query, 1 for a null field."""
    asked = F.lit(query.lower())
    distance = F.levenshtein(F.lower(F.col(field)), asked) / F.greatest(F.length(field), F.lit(max(1, len(query))))
    return F.coalesce(F.when(F.contains(F.lower(F.col(field)), asked), 0.0).otherwise(distance), F.lit(1.0))


def candidates(index: TitleIndex, query: str, threshold: float = THRESHOLD) -> DataFrame:
    """Entries that may be hits: some field shares enough sequences with the query (all, where no sequence tells)."""
    asked = query.lower()
    q = gram_size(len(asked), threshold)
    if q is None:
        return index.entries
    wanted = Counter(asked[k : k + q] for k in range(len(asked) - q + 1))
    times = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    found = index.grams.where(F.col("gram").isin(*wanted))
    shared = found.groupBy("entry", "field", "shown_length", "length").agg(F.sum(F.least("n", F.element_at(times, F.col("gram")).cast("long"))).alias("shared"))
    edits = F.floor(F.greatest("shown_length", F.lit(len(query))) * (threshold + 1e-6))
    near = F.greatest("length", F.lit(len(asked))) - (q - 1) - edits * q
    held = len(asked) - q + 1
    return index.entries.join(shared.where(F.col("shared") >= F.least(near, F.lit(held))).select("entry").distinct(), "entry", "left_semi")


def fuzzy_titles(index: TitleIndex, query: str, threshold: float = THRESHOLD, limit: int = MOST_HITS) -> DataFrame:
    """Entries whose title, author or editors are near the query, best first, with their score; at most ``threshold``."""
    score = F.round(F.least(*[field_score(c, query) for c in FIELDS]), 6)
    scored = candidates(index, query, threshold).drop("entry").withColumn("score", score)
    return scored.where(F.col("score") <= threshold).orderBy("score", "title", "url").limit(limit)
