"""Hits by form: texts turned round task by task, and the hits of each form cut into blocks of equal size.

A task turns its texts into pieces, the hits of a form in a segment of ``SEGMENT`` document numbers, four or six bytes
each beside the form.  Pieces are stored once and dealt out once, by ranges of (form, lang, segment) that hold about as
many hits each, so a frequent form is spread over ranges; a pass over a sorted range cuts its blocks.  A block that lies
in two ranges is written as fragments first, a few for each range, and put together afterwards.
"""

from __future__ import annotations

import bisect
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loculus.operators.tokens import bare_surface

#: Document numbers of a segment (two bytes tell them apart); words turned round and hits cut at once; hits of a range; samples that place its bounds.
SEGMENT, WORDS_AT_ONCE, HITS_AT_ONCE, RANGE_HITS, RANGE_SAMPLES = 4096, 4 << 20, 1 << 20, 4 << 20, 64
PIECES = "form string, lang string, segment long, n int, entries int, last long, places binary"
BLOCKS = "form string, lang string, block long, n long, from_chunk long, from_seq long, last_chunk long, last_seq long, docs array<bigint>, seqs array<int>, occs array<int>, whole boolean"
COUNTS = "form string, lang string, doc_id long, n long"
_BLOCK_COLUMNS = [c.split()[0] for c in BLOCKS.split(", ")]
_ROWS = 4096  # of a batch that goes back to Spark

Batches = Iterator[pa.RecordBatch]


def _packed(docs: np.ndarray, values: np.ndarray, heads: np.ndarray) -> pa.Array:
    """Runs that begin at heads as bytes: all documents of a run, then its values, of two bytes each, or of four where one needs them."""
    long = np.maximum.reduceat(values, heads) >= 1 << 16
    n = np.diff(np.append(heads, len(docs)))
    sizes = n * np.where(long, 3, 2)  # in units of two bytes
    offsets = np.append(0, np.cumsum(sizes))
    data = np.empty(offsets[-1], "<u2")
    run = np.repeat(np.arange(len(heads), dtype=np.int32), n)
    place = np.arange(len(docs)) + (offsets[:-1] - heads)[run]
    data[place] = docs
    place += n[run]
    if not long.any():
        data[place] = values
    else:
        wide = long[run]
        place += np.where(wide, np.arange(len(docs)) - heads[run], 0)
        data[place] = values & 0xFFFF
        data[place[wide] + 1] = values[wide] >> 16
    return pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer((offsets * 2).astype(np.int32)), pa.py_buffer(data)])


def bare_ascii(tokens: pa.Array) -> pa.Array:
    """``bare_surface`` of ASCII tokens, in which both classes of signs are the same 32; others as they are."""
    return pc.if_else(pc.string_is_ascii(tokens), pc.ascii_lower(pc.ascii_trim(tokens, string.punctuation)), tokens)


def _turned(doc_ids: np.ndarray, langs: pa.Array, tokens: pa.Array, counts: bool) -> pa.RecordBatch | None:
    """The pieces of some texts: each form's hits by segment, or with ``counts`` its number in each document."""
    lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    coded = tokens.flatten().dictionary_encode()
    folded = bare_ascii(coded.dictionary).dictionary_encode()
    forms = folded.dictionary
    by_name = pc.sort_indices(forms).to_numpy()
    rank = np.empty(len(forms), np.int64)
    rank[by_name] = np.arange(len(forms))
    codes = folded.indices.to_numpy()[coded.indices.to_numpy()]
    del coded, folded  # arrays here are as long as the texts, so those that are done with go
    spoken = langs.dictionary_encode()
    segments, segment_of = np.unique(doc_ids // SEGMENT, return_inverse=True)
    group = spoken.indices.to_numpy().astype(np.int64) * len(segments) + segment_of
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    seq = np.arange(1, len(codes) + 1, dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    rank *= len(spoken.dictionary) * len(segments)
    key = rank[codes]
    key += group[row]
    if (nothing := pc.index(forms, "").as_py()) >= 0:
        kept = codes != nothing
        row, seq, key = row[kept], seq[kept], key[kept]
    if not len(key):
        return None
    if key.max() < 1 << 31:  # plain numbers are sorted faster than indexes
        key <<= 32
        key |= np.arange(len(key))
        key.sort()
        order = (key & 0xFFFFFFFF).astype(np.int32)
        key >>= 32
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    row, seq = row[order], seq[order]
    del order, codes
    begins = np.append(True, key[1:] != key[:-1])
    heads = np.flatnonzero(begins)
    n = np.diff(np.append(heads, len(key)))
    inside = (doc_ids % SEGMENT).astype(np.int32)[row]
    last = np.maximum.reduceat(inside.astype(np.int64) << 32 | seq, heads)
    if counts:
        runs = np.flatnonzero(begins | np.append(True, row[1:] != row[:-1]))
        seq, inside, starts = np.diff(np.append(runs, len(key))), inside[runs], np.searchsorted(runs, heads)
    else:
        starts = heads
    group = key[heads] % (len(spoken.dictionary) * len(segments))
    named = forms.take(pa.array(by_name[key[heads] // (len(spoken.dictionary) * len(segments))]))
    columns = [named, spoken.dictionary.take(pa.array(group // len(segments))), pa.array(segments[group % len(segments)]), pa.array(n, pa.int32()), pa.array(np.diff(np.append(starts, len(seq))), pa.int32()), pa.array(last), _packed(inside, seq, starts)]
    return pa.RecordBatch.from_arrays(columns, ["form", "lang", "segment", "n", "entries", "last", "places"])


def pieces_of(texts: DataFrame, counts: bool = False) -> DataFrame:
    """Pieces of ``texts`` (doc_id long, lang, tokens in order); tokens without a letter or figure only take up a place.

    ASCII tokens are made bare once for each different one of a batch, others behind it, once for each piece.
    """

    def turn(batches: Batches) -> Batches:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS_AT_ONCE, "right")))
                own = batch.slice(at, to - at)
                found = _turned(own.column("doc_id").to_numpy(), own.column("lang"), own.column("tokens"), counts)
                for k in range(0, found.num_rows if found else 0, _ROWS):
                    yield found.slice(k, _ROWS)
                at = to

    pieces, form = texts.select("doc_id", "lang", "tokens").mapInArrow(turn, PIECES), F.col("form")
    return pieces.withColumn("form", F.when(F.length(form) == F.octet_length(form), form).otherwise(bare_surface(form))).where("form <> ''")


@dataclass(frozen=True)
class Ranges:
    """Where ranges begin, (form, lang, segment) each but the first; by range what of its first form lies in earlier ones: hits, and segment and place of the last."""

    bounds: list[tuple[str, str, int]]
    before: dict[int, tuple[int, int, int]]

    def begins(self, at: int) -> tuple[tuple[str, str], tuple[int, int, int]] | None:
        return (self.bounds[at - 1][:2], self.before[at]) if at in self.before else None

    def goes_on(self, at: int) -> tuple[str, str] | None:
        """The form with which the next range begins."""
        return self.bounds[at][:2] if at < len(self.bounds) else None


def plan_ranges(pieces: DataFrame, least: int) -> Ranges:
    """Ranges with about as many hits each, placed by a sample of pieces weighted by hits; only their bounds come to the driver."""
    spark, key = pieces.sparkSession, ["form", "lang", "segment"]
    total = pieces.agg(F.sum("n")).first()[0] or 0
    number = max(least, -(-total // RANGE_HITS))
    chance = (F.pmod(F.xxhash64(*key), F.lit(1 << 20)) + 0.5) / (1 << 20)
    copies = F.floor(F.col("n") * (RANGE_SAMPLES * number / max(total, 1)) + chance)
    sample = sorted(tuple(r) for r in pieces.select(*key, copies.alias("copies")).where("copies > 0").collect())
    ends = np.cumsum([s[3] for s in sample])
    places = np.searchsorted(ends, np.arange(1, number) * (ends[-1] / number), "right") if len(sample) else []
    bounds = sorted({sample[min(int(k), len(sample) - 1)][:3] for k in places})
    if not bounds:
        return Ranges([], {})
    marks = spark.createDataFrame([(k + 1, *b) for k, b in enumerate(bounds)], "_range int, form string, lang string, _from long")
    own = pieces.select(*key, "n", "last").join(F.broadcast(marks), ["form", "lang"]).where("segment < _from")  # one row per range
    earlier = own.groupBy("_range").agg(F.sum("n").alias("n"), F.max(F.struct("segment", "last")).alias("last")).collect()
    return Ranges(bounds, {r["_range"]: (r["n"], r["last"]["segment"], r["last"]["last"]) for r in earlier})


def _dealt(pieces: DataFrame, ranges: Ranges) -> DataFrame:
    """Pieces by range, sorted, each with its range."""
    bounds = ranges.bounds

    @F.arrow_udf(T.IntegerType())
    def place(forms: pa.Array, langs: pa.Array, segments: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(bounds, k) for k in zip(forms.to_pylist(), langs.to_pylist(), segments.to_pylist(), strict=True)], pa.int32())

    placed = pieces.drop("n", "last").withColumn("range", place("form", "lang", "segment"))
    return placed.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("form", "lang", "segment")


def _changes(column: pa.Array) -> np.ndarray:
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)


def _opened(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, document and place (or count) of each hit."""
    column = rows.column("places")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 2
    data = np.frombuffer(column.buffers()[2], "<u2", offsets[-1])
    # a run of two bytes a value holds two numbers a hit, one of four bytes three; which it is, its own count tells
    sizes, offsets = np.diff(offsets), offsets[:-1].astype(np.int64)
    n = rows.column("entries").to_numpy()
    row = np.repeat(np.arange(rows.num_rows), n)
    at = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    docs = data[offsets[row] + at]
    wide = (sizes == 3 * n)[row]
    if not wide.any():
        values = data[offsets[row] + n[row] + at].astype(np.int64)
    else:
        place = offsets[row] + n[row] + np.where(wide, 2 * at, at)
        values = data[place].astype(np.int64)
        values[wide] += data[place[wide] + 1].astype(np.int64) << 16
    return row, rows.column("segment").to_numpy()[row] * SEGMENT + docs, values


def _groups(batches: Batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, bool]]:
    """Runs of sorted pieces that end where a (form, lang, segment) does: rows, where a form begins, where a group begins, and whether it is the last run."""
    held, hits = [], 0

    def cut(final: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, bool]]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        forms = np.append(True, _changes(rows.column("form")) | _changes(rows.column("lang")))
        groups = forms | np.append(True, _changes(rows.column("segment")))
        to = rows.num_rows if final else int(np.flatnonzero(groups)[-1])
        held[:] = [rows.slice(to)] if to < rows.num_rows else []
        if to:
            yield rows.slice(0, to), forms[:to], groups[:to], final

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            hits += pc.sum(batch.column("entries")).as_py()
        if hits >= HITS_AT_ONCE:
            yield from cut(False)
            hits = sum(pc.sum(b.column("entries")).as_py() for b in held)
            hits = hits if hits < HITS_AT_ONCE else 0  # one group: wait for more
    if held:
        yield from cut(True)


def _lists(values: np.ndarray, heads: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(heads, len(values)), pa.int32()), pa.array(values, kind))


def _blocks(ranges: Ranges, block_hits: int, chunk_tokens: int, chunks_a_document: int) -> Callable[[Batches], Batches]:
    chunk = lambda doc, seq: doc * chunks_a_document + (seq - 1) // chunk_tokens

    def cut(batches: Batches) -> Batches:
        none = np.empty(0, np.int64)
        key, first, before, left = None, 0, None, (none, none, none)  # of the form that may go on: hits in blocks so far, the last of them, hits in no block yet
        started = False
        for rows, forms, groups, final in _groups(batches):
            if not started:
                started, at = True, ranges.begins(rows.column("range")[0].as_py())
                if at:
                    key, (first, segment, last) = at
                    doc, seq = segment * SEGMENT + (last >> 32), last & ((1 << 32) - 1)
                    before = (chunk(doc, seq), seq) if first % block_hits == 0 else None
            row, docs, seqs = _opened(rows)
            group, places = np.cumsum(groups)[row], (docs % SEGMENT << 32) | seqs
            if ((group[1:] == group[:-1]) & (places[1:] < places[:-1])).any():  # texts lay out of order, or in several files
                if group[-1] < 1 << 19:  # a segment's document has 12 bits, a place 32
                    both = np.sort(group << 44 | places)
                    group, places = both >> 44, both & ((1 << 44) - 1)
                else:
                    order = np.lexsort((places, group))
                    group, places = group[order], places[order]
                row = np.flatnonzero(groups)[group - 1]
                docs, seqs = rows.column("segment").to_numpy()[row] * SEGMENT + (places >> 32), places & 0xFFFFFFFF
            numbers = chunk(docs, seqs)
            begins = np.append(True, (group[1:] != group[:-1]) | (numbers[1:] != numbers[:-1]))
            counted = np.arange(len(docs))
            occs = counted - np.maximum.accumulate(np.where(begins, counted, 0)) + 1
            names = [rows.column(c).filter(pa.array(forms)) for c in ("form", "lang")]
            mine = (np.cumsum(forms) - 1)[row]
            same = (names[0][0].as_py(), names[1][0].as_py()) == key
            if len(left[0]) and not same:
                mine = mine + 1
                names = [pa.concat_arrays([pa.array([k], pa.string()), c]) for k, c in zip(key, names, strict=True)]
            carried = same or len(left[0]) > 0
            docs, seqs, occs = (np.concatenate(x) for x in zip(left, (docs, seqs, occs), strict=True))
            numbers, mine = chunk(docs, seqs), np.concatenate([np.zeros(len(left[0]), np.int64), mine])
            heads = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))  # of forms
            index = np.arange(len(docs)) - heads[mine] + np.where(mine == 0, first if carried else 0, 0)
            starts = np.flatnonzero(np.append(True, (mine[1:] != mine[:-1]) | (index[1:] % block_hits == 0)))
            ends = np.append(starts[1:], len(docs))
            opening = starts == heads[mine[starts]]
            from_chunk, from_seq = (np.where(opening, -1, x[np.maximum(starts - 1, 0)]) for x in (numbers, seqs))
            unknown = np.zeros(len(starts), bool)
            if carried:
                unknown[0] = before is None and first > 0
                from_chunk[0], from_seq[0] = before or (-1, -1)
            unknown |= (index[starts] % block_hits != 0)
            incomplete = (index[-1] + 1) % block_hits != 0
            key = (names[0][-1].as_py(), names[1][-1].as_py())
            emitted = len(starts) - (incomplete and not final)
            whole = index[starts] % block_hits == 0
            if final and incomplete and ranges.goes_on(rows.column("range")[rows.num_rows - 1].as_py()) == key:
                whole[-1] = False
            rest = starts[-1] if emitted < len(starts) else len(docs)
            told = ~whole[:emitted] | (np.maximum.reduceat(occs, starts)[:emitted] > 1)  # blocks of first occurrences only have no list of them
            n = (ends - starts)[:emitted]
            repeated, own = occs[:rest][np.repeat(told, n)], np.where(told, n, 0)
            made = pa.RecordBatch.from_arrays(
                [
                    *[c.take(pa.array(mine[starts[:emitted]])) for c in names],
                    pa.array(index[starts[:emitted]] // block_hits),
                    pa.array(n),
                    *[pa.array(x[:emitted], pa.int64(), mask=unknown[:emitted]) for x in (from_chunk, from_seq)],
                    *[pa.array(x[ends[:emitted] - 1], pa.int64()) for x in (numbers, seqs)],
                    *[_lists(x[:rest], starts[:emitted], k) for x, k in ((docs, pa.int64()), (seqs, pa.int32()))],
                    _lists(repeated, np.cumsum(own) - own, pa.int32()),
                    pa.array(whole[:emitted]),
                ],
                _BLOCK_COLUMNS,
            )
            for k in range(0, made.num_rows, _ROWS):
                yield made.slice(k, _ROWS)
            if rest < len(docs):
                first, before = int(index[rest]), None if unknown[-1] else (int(from_chunk[-1]), int(from_seq[-1]))
            else:
                first, before = int(index[-1]) + 1, (int(numbers[-1]), int(seqs[-1]))
            left = (docs[rest:], seqs[rest:], occs[rest:])

    return cut


def cut_blocks(pieces: DataFrame, ranges: Ranges, block_hits: int, chunk_tokens: int, chunks_a_document: int) -> DataFrame:
    """Blocks in order, and fragments (not ``whole``) of those that lie in two ranges or more; ``from_chunk`` and ``from_seq`` are null where a fragment doesn't begin its block."""
    return _dealt(pieces, ranges).mapInArrow(_blocks(ranges, block_hits, chunk_tokens, chunks_a_document), BLOCKS)


def joined_fragments(fragments: DataFrame) -> DataFrame:
    """The blocks of which there are fragments."""
    piece = F.struct("last_chunk", "last_seq", "docs", "seqs", "occs")
    grouped = fragments.groupBy("form", "lang", "block").agg(F.sum("n").alias("n"), F.max("from_chunk").alias("from_chunk"), F.max("from_seq").alias("from_seq"), F.array_sort(F.collect_list(piece)).alias("p"))
    last = F.element_at("p", -1)
    lists = [F.flatten(F.col("p")[c]).alias(c) for c in ("docs", "seqs", "occs")]
    return grouped.select("form", "lang", "block", "n", "from_chunk", "from_seq", last["last_chunk"].alias("last_chunk"), last["last_seq"].alias("last_seq"), *lists, F.lit(True).alias("whole"))


def _counts(counted: bool) -> Callable[[Batches], Batches]:
    def cut(batches: Batches) -> Batches:
        for rows, _, groups, _ in _groups(batches):
            row, docs, values = _opened(rows)
            group, n = np.cumsum(groups)[row], values if counted else np.ones(len(row), np.int64)
            if ((group[1:] == group[:-1]) & (docs[1:] < docs[:-1])).any():
                order = np.lexsort((docs, group))
                row, docs, n, group = row[order], docs[order], n[order], group[order]
            heads = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (docs[1:] != docs[:-1])))
            names = [rows.column(c).take(pa.array(row[heads])) for c in ("form", "lang")]
            made = pa.RecordBatch.from_arrays([*names, pa.array(docs[heads]), pa.array(np.add.reduceat(n, heads))], ["form", "lang", "doc_id", "n"])
            for k in range(0, made.num_rows, 8 * _ROWS):
                yield made.slice(k, 8 * _ROWS)

    return cut


def count_hits(pieces: DataFrame, ranges: Ranges, counted: bool) -> DataFrame:
    """(form, lang, doc_id, n) in order; ``counted`` says that pieces hold counts, not places."""
    return _dealt(pieces, ranges).mapInArrow(_counts(counted), COUNTS)
