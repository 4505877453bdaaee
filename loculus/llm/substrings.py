"""Exact removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte goes if it is covered by a ``LENGTH``-byte string that also starts
anywhere else in the corpus.  Sorting all suffixes would move many times the
corpus, so buckets are refined only where repeats are possible:

1. *q-gram buckets.*  Every string start chooses one q-gram inside its string
   by content (its anchor: the one with the smallest name), so starts fall into
   blocks, one per anchor, and equal strings lie in blocks of one bucket, at one
   distance from the anchor.
2. *Whole blocks.*  Blocks of a bucket whose full extents are equal are settled
   at once: (bucket, extent) is counted with map-side combination.  Buckets with
   one member are done; those with a single class of equal blocks too.
3. *Splitting.*  One block of every class in the other buckets goes on, with its
   bytes.  As long as a bucket has more than ``MOST_TOGETHER`` classes it is split
   by Spark: its starts are cut into ``PARTS`` by distance from the anchor, and the
   bytes that all strings of a part share (they reach further beyond the anchor
   with every round) name the new bucket.  Equal parts are counted and settled as
   in step 2.  After five rounds a part is a single string.
4. *Refinement.*  What is left in a bucket, a bounded number of blocks, meets in
   one task.  There buckets of suffixes by q-gram are sorted on the bucket
   identifiers further on, with the refined identifiers written back for the
   next round (``suffixes.repeated_strings``); q-grams are compared byte by byte.
5. *Removal.*  Ranges are merged in the order of the text, and each text meets its
   own and loses them.

Passages of more than 50 words that several rows share are told beside that: many
are shorter than ``LENGTH`` bytes, so they stay in the text (``passages``).

Blocks are decided on 128 bits (bucket and extent), and rows are told apart by
128 bits of id and text.  Equal rows have the same ranges, which are counted
once; those that very many rows share are known to be repeated as a whole and
take no part in joins.

Edge cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing; rows
repeated with their id are copies of each other like any others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loculus.llm.common import Scratch
from loculus.llm.files import slices, tidy
from loculus.llm.passages import WORDS, shared_ranges
from loculus.llm.suffixes import LENGTH, SEGMENT, Q, cut_blocks, repeated_strings

#: Classes of a bucket up to which they meet in one task, and parts that the starts of a larger one are cut into.
MOST_TOGETHER = 1_024
PARTS = 4
#: Equal rows count as very many from this number and this share of all rows on; so at most 1 / share of them are broadcast.
MANY_EQUAL, MANY_EQUAL_SHARE = 1_000, 1e-5
#: Names of crowded buckets are broadcast up to this number, and joined beyond it.
FEW_BUCKETS = 100_000
#: A block's place: its first start, then nine bits each for its number of starts less one and the anchor's distance.
_SPAN = 512
#: Bytes of blocks that are refined together in a task.
_REFINE_BYTES = 512 << 10
_KEY = ["key_1", "key_2"]


def _with_key(docs: DataFrame) -> DataFrame:
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return keyed.withColumns({c: F.xxhash64(F.lit(c), "doc_id", "text") for c in _KEY})


def text_blocks(keyed: DataFrame) -> DataFrame:
    """(bucket, extent, key, place) of every block of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            columns: list[list] = [[], [], [], [], []]
            for text, *key in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in _KEY), strict=True):
                data = text.as_buffer().to_pybytes()
                for at in range(0, len(data) - LENGTH + 1, SEGMENT):
                    part = data[at : at + SEGMENT + LENGTH - 1]
                    bucket, first, last, anchor = cut_blocks(np.frombuffer(part, np.uint8))
                    extents = [xxhash.xxh3_64_intdigest(part[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)]
                    columns[0].append(bucket.view(np.int64))
                    columns[1].append(np.array(extents, np.uint64).view(np.int64))
                    columns[2].append(np.full(len(bucket), key[0], np.int64))
                    columns[3].append(np.full(len(bucket), key[1], np.int64))
                    columns[4].append(((first + at) * _SPAN + (last - first)) * _SPAN + (anchor - first))
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["bucket", "extent", *_KEY, "place"])
        tidy()

    return keyed.where(F.octet_length("text") >= LENGTH).select("text", *_KEY).mapInArrow(run, "bucket long, extent long, key_1 long, key_2 long, place long")


PIECES = "bucket long, key_1 long, key_2 long, first long, alone boolean, away int, low int, high int, piece binary"
_PIECE_SCHEMA = pa.schema(
    [
        ("bucket", pa.int64()),
        ("key_1", pa.int64()),
        ("key_2", pa.int64()),
        ("first", pa.int64()),
        ("alone", pa.bool_()),
        ("away", pa.int32()),
        ("low", pa.int32()),
        ("high", pa.int32()),
        ("piece", pa.binary()),
    ]
)


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of listed blocks; ``away`` is the anchor's distance from ``first``, and distances lie in [low, high)."""
    for batch in slices(batches, "text", 1 << 20):
        rows = []
        for text, one, two, blocks in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in (*_KEY, "blocks")), strict=True):
            data = text.as_buffer().to_pybytes()
            for b in blocks:
                place, away = divmod(b["place"], _SPAN)
                first, more = divmod(place, _SPAN)
                rows.append((b["bucket"], one, two, first, b["alone"], away, 0, LENGTH - Q + 1, data[first : first + more + LENGTH]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE_SCHEMA, strict=True)], schema=_PIECE_SCHEMA)


def _split_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece cut by its starts' distance from the anchor, [low, high), into ``PARTS``, under new bucket names; ``extent`` names all its bytes."""
    schema = _PIECE_SCHEMA.append(pa.field("extent", pa.int64()))
    for batch in slices(batches, "piece", 1 << 20):
        rows = []
        for bucket, one, two, first, alone, away, low, high, piece in zip(*(batch.column(f.name).to_pylist() for f in _PIECE_SCHEMA), strict=True):
            bounds = sorted({low + (high - low) * k // PARTS for k in range(PARTS + 1)})
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                begin, end = max(0, away - hi + 1), min(len(piece) - LENGTH + 1, away - lo + 1)  # starts that lie so far away
                if begin < end:
                    part, distance = piece[begin : end + LENGTH - 1], away - begin
                    shared = part[distance - lo : distance + LENGTH + 1 - hi]  # what all strings of the new bucket have
                    name = xxhash.xxh3_64_intdigest(shared, seed=(bucket ^ (lo << 40) ^ (hi << 50)) & (1 << 64) - 1)
                    rows.append((_signed(name), one, two, first + begin, alone, distance, lo, hi, part, _signed(xxhash.xxh3_64_intdigest(part))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (key, start, stop) of repeated strings, for whole buckets in sorted order."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        pieces = rows.column("piece").to_pylist()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(sizes) - sizes
        at = repeated_strings(np.frombuffer(b"".join(pieces), np.uint8), sizes)
        row = np.searchsorted(begins, at, "right") - 1
        open_ = rows.column("alone").to_numpy()[row]  # the others are repeated as a whole
        at, row = at[open_], row[open_]
        heads = np.ones(len(at), bool)
        heads[1:] = (np.diff(row) != 0) | (np.diff(at) != 1)
        head = np.flatnonzero(heads)
        tail = np.concatenate([head[1:], [len(at)]]).astype(np.int64)[: len(head)] - 1
        of = row[head]
        base = rows.column("first").to_numpy()[of] - begins[of]
        columns = [*(rows.column(c).to_numpy()[of] for c in _KEY), base + at[head], base + at[tail] + LENGTH]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*_KEY, "start", "stop"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, "piece", _REFINE_BYTES):
        held.append(batch)
        size += batch.nbytes
        buckets = batch.column("bucket").to_numpy()
        if size < _REFINE_BYTES or buckets[0] == buckets[-1] and len(held) == 1:
            continue
        rows = pa.Table.from_batches(held)
        names = rows.column("bucket").to_numpy()
        cut = int(np.searchsorted(names, names[-1]))
        if cut:
            yield settle(rows.slice(0, cut))
        held = rows.slice(cut).to_batches()
        size = sum(b.nbytes for b in held)
    if held:
        yield settle(pa.Table.from_batches(held))
    tidy()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their ranges, and what went."""
    for batch in slices(batches, "text"):
        rows = []
        plain = (batch.column(c).to_pylist() for c in ("doc_id", "n_equal", "n_shared_words", "n_shared_runs"))
        for text, ranges, doc_id, equal, words, runs in zip(batch.column("text"), batch.column("ranges"), *plain, strict=True):
            data = text.as_buffer().to_pybytes()
            merged: list[list[int]] = []
            if ranges.is_valid:
                starts, stops = (ranges.values.field(k).to_numpy() for k in (0, 1))
                order = np.argsort(starts, kind="stable")
                for a, b in zip(starts[order].tolist(), stops[order].tolist(), strict=True):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
            kept = b"".join(data[a:b] for a, b in zip([0, *(m[1] for m in merged)], [*(m[0] for m in merged), len(data)], strict=True))
            n_words = len(data.split()) if equal or words else 0
            if equal and n_words >= WORDS:  # equal rows share all they have
                words, runs = n_words, 1
            found = (doc_id, len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept, [x for m in merged for x in m])
            rows.append((*found, n_words, words or 0, runs or 0))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed", "n_words", "n_shared_words", "n_shared_runs"],
            )


def repeated_blocks(keyed: DataFrame, many: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(settled, open): ranges of blocks that are repeated as a whole, but for rows in ``many``; and one block per class of the buckets to refine."""
    blocks = scratch.table(text_blocks(keyed), "blocks")
    classes = scratch.table(
        blocks.groupBy("bucket", "extent").agg(
            F.count("*").alias("n"),
            F.min(F.struct(*_KEY, "place")).alias("block"),
        ).select("bucket", "extent", "n", "block.*"), "classes"
    )
    scratch.release()
    crowded = classes.groupBy("bucket").agg(F.count("*").alias("classes")).where("classes > 1")
    open_ = scratch.table(classes.join(crowded, "bucket").select("bucket", *_KEY, "place", (F.col("n") == 1).alias("alone")), "open")
    first, more = F.floor(F.col("place") / (_SPAN * _SPAN)), F.floor(F.col("place") / _SPAN) % _SPAN
    whole = blocks.join(F.broadcast(many), _KEY, "left_anti").join(classes.where("n > 1").select("bucket", "extent"), ["bucket", "extent"])
    settled = scratch.table(whole.select(*_KEY, first.alias("start"), (first + more + LENGTH).alias("stop")).distinct(), "settled")
    scratch.drop("blocks", "classes")
    scratch.release()
    return settled, open_


def split_buckets(pieces: DataFrame, scratch: Scratch, most_together: int) -> tuple[DataFrame, DataFrame | None]:
    """(pieces, ranges): pieces in buckets of bounded size, and ranges of what was settled on the way there."""
    settled, done, found = [], [], pieces
    for k in range(1, 11):
        crowded = scratch.table(found.groupBy("bucket").count().where(F.col("count") > most_together).select("bucket"), f"crowded-{k}")
        number = crowded.count()
        if not number:
            break
        names = F.broadcast(crowded) if number <= FEW_BUCKETS else crowded
        done.append(found.join(names, "bucket", "left_anti"))
        parts = scratch.table(found.join(names, "bucket", "left_semi").mapInArrow(_split_pieces, PIECES + ", extent long"), f"parts-{k}")
        classes = parts.groupBy("bucket", "extent").agg(F.count("*").alias("n"), F.min(F.struct(*_KEY, "first")).alias("one"))
        classes = scratch.table(classes, f"classes-{k}")
        repeated = parts.where("alone").join(classes.where("n > 1").select("bucket", "extent"), ["bucket", "extent"])
        settled.append(repeated.select(*_KEY, F.col("first").alias("start"), (F.col("first") + F.octet_length("piece")).alias("stop")))
        several = classes.groupBy("bucket").agg(F.count("*").alias("classes")).where("classes > 1").select("bucket")
        kept = classes.join(several, "bucket").select("bucket", *[F.col(f"one.{c}").alias(c) for c in (*_KEY, "first")], F.col("n").alias("n"))
        found = parts.join(kept, ["bucket", *_KEY, "first"])
        found = scratch.table(found.withColumn("alone", F.col("alone") & (F.col("n") == 1)).select(*[f.name for f in _PIECE_SCHEMA]), f"pieces-{k}")
    for more in done:
        found = found.unionByName(more)
    ranges = None
    for more in settled:
        ranges = more if ranges is None else ranges.unionByName(more)
    return found, ranges


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """(key, run, start, stop): ranges with overlapping and touching ones merged."""
    order = Window.partitionBy(*_KEY).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    runs = opened.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*_KEY, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def remove_repeats(docs: DataFrame, scratch: Scratch, most_together: int = MOST_TOGETHER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), removed (flat list of range bounds), n_words, n_shared_words, n_shared_runs.

    Shared words and runs are those of passages of ``WORDS`` words or more that other rows have too; ``n_words`` is 0 where there are none.
    """
    keyed = _with_key(docs)
    equal = scratch.table(keyed.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1"), "equal-rows")
    rows = docs.count()
    many = scratch.table(equal.where(F.col("n") > max(MANY_EQUAL, int(rows * MANY_EQUAL_SHARE))).select(*_KEY), "many-equal-rows")
    some = many.count()  # each has more than this share of all rows, so there are few
    shared = merged_ranges(shared_ranges(keyed, many, scratch)).groupBy(*_KEY)
    shared = scratch.table(shared.agg(F.sum(F.col("stop") - F.col("start")).alias("n_shared_words"), F.count("*").alias("n_shared_runs")), "shared-words")
    settled, open_ = repeated_blocks(keyed, many, scratch)
    single = keyed.join(F.broadcast(many), _KEY, "left_anti") if some else keyed
    texts = single.repartition(*_KEY)  # one shuffle of the texts, read both to refine and to remove
    listed = open_.groupBy(*_KEY).agg(F.collect_list(F.struct("bucket", "place", "alone")).alias("blocks"))
    sources = texts.join(listed, _KEY).select("text", *_KEY, "blocks")
    if some:  # one of each stands for the others
        sources = sources.unionByName(keyed.join(F.broadcast(many), _KEY).dropDuplicates(_KEY).join(listed, _KEY).select("text", *_KEY, "blocks"))
    pieces = scratch.table(sources.mapInArrow(_cut_pieces, PIECES), "pieces")
    scratch.release()
    pieces, ranges = split_buckets(pieces, scratch, most_together)
    refined = pieces.repartition("bucket").sortWithinPartitions("bucket", *_KEY, "first").mapInArrow(_refine, "key_1 long, key_2 long, start long, stop long")
    every = settled.unionByName(refined)
    spans = merged_ranges(every if ranges is None else every.unionByName(ranges))
    gathered = spans.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    told = ["n_equal", "n_shared_words", "n_shared_runs"]
    joined = texts.join(gathered, _KEY, "left").join(equal.withColumnRenamed("n", "n_equal"), _KEY, "left").join(shared, _KEY, "left").select("doc_id", "text", "ranges", *told)
    if some:
        whole = F.when(F.octet_length("text") >= LENGTH, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("stop"))))
        joined = joined.unionByName(keyed.join(F.broadcast(many), _KEY).select("doc_id", "text", whole.alias("ranges"), F.lit(2).cast("long").alias("n_equal"), *[F.lit(None).cast("long").alias(c) for c in told[1:]]))
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<long>, n_words long, n_shared_words long, n_shared_runs long")
