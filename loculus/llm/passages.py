"""Passages of ``WORDS`` words or more that stand in several documents, found exactly.

Byte strings of one length miss passages that are long in words and short in
bytes.  Here texts are sequences of word names (64-bit hashes), and the method is
the sampling of ``substrings`` on words:

1. every run of ``WORDS`` words chooses one ``GRAM``-word run inside it by content
   alone, so texts fall into blocks, and equal runs lie in blocks of one bucket;
2. buckets that only one document has are done; blocks that are equal as a whole
   in several documents are settled by counting;
3. what is left in mixed buckets, with one block of each settled class, is cut
   into its runs, and these are counted under 128-bit names.

Rows with the same key are counted by the caller: they share all their runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import Scratch
from loculus.llm.files import slices, tidy
from loculus.llm.suffixes import SEGMENT, cut_blocks, qgram_names

#: Words of a passage at least, and of the runs by which passages meet.
WORDS, GRAM = 51, 20
#: A block's place: its first word, then nine bits for its number of runs less one.
_SPAN = 512
_KEY = ["key_1", "key_2"]


def word_names(text: bytes) -> np.ndarray:
    """A 64-bit name of every word; bytes are split at the blank and the ASCII controls 9 to 13."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_blocks(keyed: DataFrame) -> DataFrame:
    """(bucket, extent, key, place) of every block of word runs of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            columns: list[list] = [[], [], [], [], []]
            for text, *key in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in _KEY), strict=True):
                names = word_names(text.as_buffer().to_pybytes())
                for at in range(0, len(names) - WORDS + 1, SEGMENT):
                    part = names[at : at + SEGMENT + WORDS - 1]
                    bucket, first, last, _ = cut_blocks(part, WORDS, GRAM)
                    raw = part.tobytes()
                    extents = [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(first.tolist(), (last + WORDS).tolist(), strict=True)]
                    columns[0].append(bucket.view(np.int64))
                    columns[1].append(np.array(extents, np.uint64).view(np.int64))
                    columns[2].append(np.full(len(bucket), key[0], np.int64))
                    columns[3].append(np.full(len(bucket), key[1], np.int64))
                    columns[4].append((first + at) * _SPAN + (last - first))
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["bucket", "extent", *_KEY, "place"])
        tidy()

    enough = keyed.where(F.octet_length("text") >= 2 * WORDS - 1)
    return enough.select("text", *_KEY).mapInArrow(run, "bucket long, extent long, key_1 long, key_2 long, place long")


RUNS = "one long, two long, key_1 long, key_2 long, start long, settled boolean"


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the word runs of listed blocks."""
    for batch in slices(batches, "text", 1 << 20):
        columns: list[list] = [[], [], [], [], [], []]
        for text, one, two, blocks in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in (*_KEY, "blocks")), strict=True):
            names = word_names(text.as_buffer().to_pybytes())
            for b in blocks:
                first, more = divmod(b["place"], _SPAN)
                part = names[first : first + more + WORDS]
                columns[0].append(qgram_names(part, 0, WORDS).view(np.int64))
                columns[1].append(qgram_names(part, 1, WORDS).view(np.int64))
                columns[2].append(np.full(more + 1, one, np.int64))
                columns[3].append(np.full(more + 1, two, np.int64))
                columns[4].append(np.arange(first, first + more + 1))
                columns[5].append(np.full(more + 1, b["settled"]))
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["one", "two", *_KEY, "start", "settled"])
    tidy()


def _in_several() -> Column:
    """Whether the rows of a group have several keys."""
    differ = [F.min(c) != F.max(c) for c in _KEY]
    return differ[0] | differ[1]


def shared_ranges(keyed: DataFrame, many: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, start, stop): ranges of words of passages that several keys have, but for rows in ``many``; overlapping ones aren't merged."""
    blocks = scratch.table(word_blocks(keyed), "word-blocks")
    buckets = blocks.groupBy("bucket").agg(_in_several().alias("several"), (F.min("extent") != F.max("extent")).alias("mixed"))
    met = scratch.table(blocks.join(buckets.where("several").select("bucket", "mixed"), "bucket"), "word-blocks-met")
    scratch.drop("word-blocks")
    classes = met.groupBy("bucket", "extent").agg(_in_several().alias("settled"), F.min(F.struct(*_KEY, "place")).alias("one"))
    met = scratch.table(met.join(classes, ["bucket", "extent"]), "word-blocks-classed")
    scratch.drop("word-blocks-met")
    first, more = F.floor(F.col("place") / _SPAN), F.col("place") % _SPAN
    whole = met.where("settled").join(F.broadcast(many), _KEY, "left_anti")
    whole = scratch.table(whole.select(*_KEY, first.alias("start"), (first + more + WORDS).alias("stop")), "word-ranges-whole")

    open_ = met.where(F.col("mixed") & (~F.col("settled") | (F.struct(*_KEY, "place") == F.col("one"))))
    listed = scratch.table(open_.groupBy(*_KEY).agg(F.collect_set(F.struct("place", "settled")).alias("blocks")), "word-blocks-open")
    scratch.drop("word-blocks-classed")
    scratch.release()
    sources = keyed.join(F.broadcast(many), _KEY, "left_anti").join(listed, _KEY)
    sources = sources.unionByName(keyed.join(F.broadcast(many), _KEY, "left_semi").dropDuplicates(_KEY).join(listed, _KEY))
    runs = scratch.table(sources.select("text", *_KEY, "blocks").mapInArrow(_cut_runs, RUNS), "word-runs")
    scratch.release()
    shared = runs.groupBy("one", "two").agg((_in_several() | F.bool_or("settled")).alias("shared")).where("shared").select("one", "two")
    single = runs.where("not settled").join(shared, ["one", "two"])
    parts = scratch.table(single.select(*_KEY, "start", (F.col("start") + WORDS).alias("stop")), "word-ranges-parts")
    scratch.drop("word-runs", "word-blocks-open")
    scratch.release()
    return whole.unionByName(parts)
