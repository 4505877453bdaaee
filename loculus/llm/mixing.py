"""Mixing sources to target weights.

Each document gets a hash-random key.  Documents of a source are range-sorted
by that key: the key's leading hex digits name a range, ranges are summed with
map-side combination, and a running sum over the range totals of a source finds
the range that holds the source's cut.  Inside it the same step is made for keys
(with leading digits of the text's hash, for ids that many rows share) and then
for single texts, so no step ever orders more than a small part of a source.  A
source takes whole epochs of itself first and then documents in key order up to
the exact budget; the document at the cut is taken in part.

Only DataFrame functions are used.  A hot source is split over its key ranges,
so no task ever sums a whole source.  The number of ranges follows from the
number of rows.  The cuts (one row per source) go back to the documents by an
ordinary join, which Spark broadcasts only when it has measured the cuts to be
small and otherwise splits at hot sources.

Edge cases: a null text has size 0; a null source is a source of its own, last
in order; rows that share a doc_id follow each other by their texts' hashes, and
equal rows share what is left at the cut evenly, the first of them one word
more (in ``mixed_documents`` each rounds its share up or down by chance of its row number); documents with size 0 are never taken; an
empty table gives an empty result.  Other columns are ignored or, in
``mixed_documents``, carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.llm.common import WORD_JAVA, Scratch, spread_key, word_count

#: Share of all words that the mix holds, and weights of sources in order, repeating.
SHARE = 1.5
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is taken at most so many times.
MAX_EPOCHS = 2
#: Leading hex digits of the key that name a range: at least, and so many that a range has about so many rows.
RANGE_DIGITS, RANGE_ROWS = 3, 10_000
#: Leading hex digits of a text's hash that are looked at before single texts are.
TIE_DIGITS = 3


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to one row per source (``source_key``, ``source_size``).

    Sharing the excess of capped sources by weight until none is above its cap
    ends at one common level: a source gets ``min(cap, level * weight)``.  With
    sources ordered by cap per weight the capped ones come first, and the level
    is what is left for the others divided by their weights.
    """
    order = Window.orderBy("source_key")
    all_rows = Window.partitionBy()
    before = Window.orderBy("cap_per_weight", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.select(
        "source_key",
        "source_size",
        F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
    ).withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = ranked.withColumn("level", left / left_weight)
    level = F.max(F.when(F.col("cap_per_weight") > F.col("level"), F.col("level"))).over(all_rows)
    return levelled.select("source_key", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def _source_key(source: Column) -> Column:
    """Orders by code point with null last, and joins null to null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def range_digits(rows: int) -> int:
    """Leading hex digits of a key so that a range has ``RANGE_ROWS`` rows or fewer on average."""
    digits = RANGE_DIGITS
    while 16**digits * RANGE_ROWS < rows:
        digits += 1
    return digits


def _narrowed(rows: DataFrame, cuts: DataFrame, known: list[str], by: list[str]) -> DataFrame:
    """``cuts`` (source_key, known columns, start, rest) with the value of ``by`` that holds the cut, what comes before it, and its ``held`` words."""
    sums = rows.join(cuts, ["source_key", *known]).groupBy("source_key", *known, "start", "rest", *by).agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("source_key").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("start", F.col("start") + F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    return placed.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("held")))


def source_cuts(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, digits: int | None = None) -> DataFrame:
    """Where each source is cut: one row per source of ``sized`` (source_key, key, tie, size).

    Whole ``epochs`` come first; documents before (``cut_key``, ``cut_tie``) are
    taken once more, and those at it take ``cut_words`` of ``cut_size`` words.
    """
    digits = digits or range_digits(sized.count())
    ranged = sized.select("source_key", F.substring("key", 1, digits).alias("range"), "key", F.substring("tie", 1, TIE_DIGITS).alias("tie_range"), "tie", "size")
    ranges = ranged.groupBy("source_key", "range").agg(F.sum("size").alias("size"))
    totals = ranges.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    budgets = (
        source_targets(totals, weights, share, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    )
    cuts = budgets.select("source_key", F.lit(0).cast("long").alias("start"), "rest")
    cuts = _narrowed(ranges, cuts, [], ["range"]).drop("held")
    cuts = _narrowed(ranged, cuts, ["range"], ["key", "tie_range"]).drop("held")
    cuts = _narrowed(ranged, cuts, ["range", "key", "tie_range"], ["tie"])
    cut = cuts.select(
        "source_key",
        F.col("key").alias("cut_key"),
        F.col("tie").alias("cut_tie"),
        F.col("held").alias("cut_size"),
        (F.col("rest") - F.col("start")).alias("cut_words"),
    )
    return budgets.join(cut, "source_key", "left")


def _last_epoch(size: Column) -> Column:
    """What the last, partial epoch takes of a document that is joined to its source's cut."""
    here, cut = F.struct("key", "tie"), F.struct(F.col("cut_key").alias("key"), F.col("cut_tie").alias("tie"))
    return (
        F.when(F.col("cut_key").isNull(), F.when(F.col("rest") > 0, size).otherwise(0))
        .when(here == cut, F.floor(size * F.col("cut_words") / F.col("cut_size") + F.col("chance")))
        .when(here < cut, size)
        .otherwise(0)
        .cast("long")
    )


def _keys(source: Column, doc_id: Column, text: Column, seed: str) -> list[Column]:
    """source_key, key, tie, size and chance (of rounding up, by the row's number) of a document."""
    tie = F.lower(F.lpad(F.hex(F.xxhash64(F.coalesce(text, F.lit("")))), 16, "0"))
    chance = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / float(1 << 20)
    named = {"source_key": _source_key(source), "key": spread_key(F.lit(seed), doc_id), "tie": tie, "size": word_count(text), "chance": chance}
    return [c.alias(n) for n, c in named.items()]


def mix(docs: DataFrame, scratch: Scratch, seed: str = "mix", **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted).

    Equal rows at a cut are counted through, so their shares add up to what is left there, and the result is the same
    however the table is dealt out.
    """
    keys = _keys(F.col("source"), F.col("doc_id"), F.col("text"), seed)
    sized = scratch.table(docs.select("doc_id", *keys, F.monotonically_increasing_id().alias("row")), "sized")
    cuts = scratch.table(source_cuts(sized, **options), "cuts")
    joined = sized.join(cuts, "source_key")
    whole = F.col("epochs") * F.col("size")
    at_cut = F.coalesce((F.col("key") == F.col("cut_key")) & (F.col("tie") == F.col("cut_tie")), F.lit(False))
    columns = ["doc_id", "size", "source_size", "target"]
    clear = joined.where(~at_cut).select(*columns, (whole + _last_epoch(F.col("size"))).alias("taken"))

    # ranks of a source's equal rows: inside a partition of the stored table, and behind those of earlier partitions
    equal = joined.where(at_cut).withColumn("part", F.shiftright("row", 33))
    earlier = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = equal.groupBy("source_key", "part").agg(F.count("*").alias("n"))
    before = counts.select("source_key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source_key", "part").orderBy("row")) + F.col("before")
    share = F.expr("size * cut_words div cut_size")
    over = F.col("cut_words") - share * F.expr("cut_size div size")  # words that are left when each row has its share
    taken = whole + share + F.when(rank <= over, 1).otherwise(0)
    ranked = equal.join(before, ["source_key", "part"]).select(*columns, taken.cast("long").alias("taken"))
    return clear.unionByName(ranked)


def mixed_documents(docs: DataFrame, scratch: Scratch, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: ``docs``' rows with their columns, once per whole epoch and once more in the last one.

    A document at a source's cut comes in the last epoch with its first words
    only, joined by single spaces; ``n_chars`` follows where it exists.
    """
    packed = docs.select(F.struct("*").alias("doc"))  # whatever the columns' names are
    doc = F.col("doc")
    keyed = packed.select("doc", *_keys(doc["source"], doc["doc_id"], doc["text"], seed))
    sized = scratch.table(keyed.select("source_key", "key", "tie", "size"), "sized")
    cuts = scratch.table(source_cuts(sized, **options), "cuts")
    joined = keyed.join(cuts, "source_key").withColumn("part", _last_epoch(F.col("size")))
    copies = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    repeated = joined.where((copies > 0) & (F.col("size") > 0)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    repeated = repeated.withColumn("short", (F.col("copy") > F.col("epochs")) & (F.col("part") < F.col("size")))
    words = F.regexp_extract_all(doc["text"], F.lit(f"({WORD_JAVA})"), F.lit(1))
    head = F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " ")
    out = repeated.select("doc", "short", F.when(F.col("short"), head).otherwise(doc["text"]).alias("new_text"))
    replaced = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(F.col("short"), F.length("new_text").cast("long")).otherwise(doc["n_chars"])
    return out.select(*[replaced.get(c, doc[c]).alias(c) for c in docs.columns])
