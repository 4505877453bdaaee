"""Near-duplicate groups by similarity of word shingles: SimHash links first, exact prefix filtering for the rest.

Links are pairs of texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more, and all of them count: groups are the components of
the graph that comparing every pair would give, whatever kind of edit lies
between two texts.  Texts with the same words collapse first.

1. *SimHash.*  Fingerprints over the shingles are linked within three bits by
   deletion-variant signatures (``simhash.signature_links``) and the links are
   checked on the shingles.  That finds most near copies and joins large groups
   of them by a forest; at 0.8 itself fingerprints differ by some ten bits,
   which no index of this kind reaches.
2. *Prefix filtering.*  Two sets that are this similar share a shingle among the
   first fifth of each, in any order of shingles that is the same for all texts.
   The order is by hash, with shingles that are common in a sample last; it
   changes only how much is compared.  Texts meet under each shingle of their
   prefixes: up to ``PAIRED_GROUP`` texts give all pairs that sizes and places
   allow, more give one pair of each text with a head.  Shingles that very many
   texts have are salted, with one head for all their salts.
3. *Bitmaps.*  Candidates are thinned by bitmaps of parities, one bit for about
   two shingles: two bitmaps differ in no more bits than the sets differ in
   shingles, so no link is lost.  Pairs that are in one component by now need no
   check either; the others are verified on the whole sets.
4. *Open groups.*  Where a large group's texts are then still in several
   components, texts outside its largest one are compared with all the others,
   in blocks of bounded size: bitmaps first, so that only texts which these leave
   in need their whole sets; only links leave such a block.

Whole sets are made from the documents again, for the texts that need them.  A
bitmap of hashes of bounded size, which loses none of them, goes to the documents
first, so few others are shuffled to meet them.

Texts are told apart by 64-bit hashes of their words: among 10 billion different
texts two or three pairs are expected to share one.

Edge cases: letter case of A-Z and kinds of white space don't count; texts
without words form one group; shorter texts are one shingle; repeated rows
form a group like other copies; an empty table gives an empty result; columns
of any name are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import Scratch, delete_path
from loculus.llm.files import slices, tidy
from loculus.llm.graph import components
from loculus.llm.simhash import majority_bits, shingle_digests, signature_links, words_of

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Texts that the order of shingles is learned from, and shingles that it puts last (it never changes what is found).
SAMPLE_TEXTS = 5_000
COMMON_SHINGLES = 50_000
#: Groups up to this size are compared pair by pair at once.
PAIRED_GROUP = 64
#: Shingles that the sample expects in more texts are dealt over salts of this size.
SALT_TEXTS = 8_192
#: Texts and shingles of a block of a larger group.
BLOCK_TEXTS = 1_024
BLOCK_SHINGLES = 1 << 22
#: Bits (a power of 2) and bits of a row of the bitmap of texts that are looked up.
LOOKUP_BITS = 1 << 24
_ROW_BITS = 64
_SALT = np.int64(0x5851F42D4C957F2D)
#: Words of 64 bits that are compared at once.
_CELLS = 1 << 20


def shingle_set(digests: bytes) -> np.ndarray:
    """Distinct shingles of a text as signed longs; a text without words has the one shingle 0."""
    return np.unique(np.frombuffer(digests, ">u8").astype(np.uint64)).view(np.int64) if digests else np.zeros(1, np.int64)


def parity_bitmap(shingles: np.ndarray) -> bytes:
    """Parities of shingles by their low bits; as many bits as the largest power of two up to their number, 64 at least."""
    bits = 1 << max(6, len(shingles).bit_length() - 1)
    return np.packbits((np.bincount(shingles & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_common(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles sets of these sizes must share."""
    return np.ceil(similarity / (1 + similarity) * (a + b) - 1e-6).astype(np.int64)


def may_link(size_a: np.ndarray, size_b: np.ndarray, maps_a: list[bytes], maps_b: list[bytes], similarity: float) -> np.ndarray:
    """Which pairs their bitmaps don't rule out."""
    least = least_common(size_a, size_b, similarity)
    most, far = size_a + size_b - 2 * least, np.zeros(len(size_a), np.int64)
    shapes = np.array([len(a) << 32 | len(b) for a, b in zip(maps_a, maps_b, strict=True)], np.int64)
    for shape in np.unique(shapes).tolist():
        at = np.flatnonzero(shapes == shape)
        one, two = (np.frombuffer(b"".join([maps[i] for i in at.tolist()]), np.uint8).reshape(len(at), -1) for maps in (maps_a, maps_b))
        while one.shape[1] != two.shape[1]:  # the parities of a smaller map are those of the larger one's halves together
            long = one if one.shape[1] > two.shape[1] else two
            folded = long[:, : long.shape[1] // 2] ^ long[:, long.shape[1] // 2 :]
            one, two = (folded, two) if long is one else (one, folded)
        far[at] = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
    return (far <= most) & (np.minimum(size_a, size_b) >= least)


def possible_partners(sizes: np.ndarray, maps: list[bytes], labels: np.ndarray, probes: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """Which texts the bitmaps leave a link for between ``probes`` and ``others`` of two labels: the rule of ``may_link``, for all these pairs."""
    live = np.zeros(len(sizes), bool)
    widths = np.fromiter(map(len, maps), np.int64, len(maps))

    def shaped(rows: np.ndarray, width: int) -> np.ndarray:
        bits = np.frombuffer(b"".join([maps[i] for i in rows.tolist()]), np.uint64).reshape(len(rows), -1)
        while bits.shape[1] > width // 8:
            bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
        return bits

    for w in np.unique(widths[probes]).tolist():
        for v in np.unique(widths[others]).tolist():
            rows, to = probes[widths[probes] == w], others[widths[others] == v]
            if min(sizes[rows].max(), sizes[to].max()) < similarity * max(sizes[rows].min(), sizes[to].min()) - 1:
                continue  # too different in size, all of them
            one, two = shaped(rows, min(w, v)), shaped(to, min(w, v))
            step = max(1, _CELLS // (len(to) * one.shape[1]))
            for k in range(0, len(rows), step):
                at = rows[k : k + step]
                a, b = sizes[at][:, None], sizes[to][None, :]
                least = least_common(a, b, similarity)
                able = (np.minimum(a, b) >= least) & (labels[at][:, None] != labels[to][None, :])
                able &= np.bitwise_count(one[k : k + step, None, :] ^ two[None, :, :]).sum(axis=2, dtype=np.int64) <= a + b - 2 * least
                live[at[able.any(axis=1)]] = True
                live[to[able.any(axis=0)]] = True
    return live


@dataclass
class ShingleOrder:
    """Shingles that come last: sorted, with their places from rare to common (from 1), numbers of salts, and a text that has each."""

    common: np.ndarray
    places: np.ndarray
    salts: np.ndarray
    heads: np.ndarray

    def prefix(self, shingles: np.ndarray, text: int, similarity: float) -> np.ndarray:
        """The first shingles of a set, so many that a set of this ``similarity`` shares one of its own first ones; salted by the text."""
        at, known = self.find(shingles)
        place = np.where(known, self.places[at], 0) if len(self.common) else np.zeros(len(shingles), np.int64)
        most = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-6)) + 1
        first = np.lexsort((shingles, place))[:most]
        out = shingles[first]
        if len(self.common) and known[first].any():
            salts = np.where(known[first], self.salts[at[first]], 1)
            with np.errstate(over="ignore"):
                out = np.where(salts > 1, out + (np.uint64(text & 0xFFFFFFFFFFFFFFFF) % salts.astype(np.uint64) + np.uint64(1)).astype(np.int64) * _SALT, out)
        return out

    def find(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.common):
            return np.zeros(len(shingles), np.int64), np.zeros(len(shingles), bool)
        at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
        return at, self.common[at] == shingles

    def salted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(salted shingle, shingle, head) of every salt, sorted by the first."""
        which = np.flatnonzero(self.salts > 1)
        rows = np.repeat(which, self.salts[which])
        number = np.arange(len(rows)) - np.repeat(np.cumsum(self.salts[which]) - self.salts[which], self.salts[which]) + 1
        with np.errstate(over="ignore"):
            keys = self.common[rows] + number * _SALT
        order = np.argsort(keys)
        return keys[order], self.common[rows][order], self.heads[rows][order]


def _words_hash(words: list[bytes]) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(b" ".join(words))[:8], "big", signed=True)


def _shingle_order(keyed: DataFrame, shingle_words: int) -> ShingleOrder:
    """Learned from a sample of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            sets = [shingle_set(shingle_digests(w, shingle_words)) for w in words]
            owners = np.repeat(np.array([_words_hash(w) for w in words], np.int64), list(map(len, sets)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(owners)], names=["shingle", "text"])
        tidy()

    share = max(1, keyed.count() // SAMPLE_TEXTS)
    texts = keyed.where(F.pmod(F.xxhash64("text_hash"), F.lit(share)) == 0).dropDuplicates(["text_hash"]).select("text")
    counts = texts.mapInArrow(run, "shingle long, text long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("text").alias("head")).where("n >= 3")
    rows = counts.orderBy(F.col("n").desc(), "shingle").limit(COMMON_SHINGLES).collect()
    common, heads = (np.array([r[c] for r in rows], np.int64) for c in ("shingle", "head"))
    salts = np.array([-(-r.n * share // SALT_TEXTS) for r in rows], np.int64)
    order = np.argsort(common)
    return ShingleOrder(common[order], np.arange(len(rows), 0, -1)[order], salts[order], heads[order])


def _sketches(keyed: DataFrame, order: ShingleOrder, shingle_words: int, similarity: float) -> DataFrame:
    """doc_id, text_hash, words_hash, and for the first row of each text in a task n, fp, bitmap and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # as many as a task has rows
        for batch in slices(batches, "text"):
            same, rows = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                name = _words_hash(words)
                same.append(name)
                if name in seen:
                    rows.append((None, None, None, None))
                    continue
                seen.add(name)
                digests = shingle_digests(words, shingle_words)
                shingles = shingle_set(digests)
                print_ = np.uint64(majority_bits(digests)).view(np.int64) if digests else 0
                rows.append((len(shingles), int(print_), parity_bitmap(shingles), order.prefix(shingles, name, similarity)))
            n, prints, maps, prefixes = zip(*rows, strict=True)
            columns = [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(same, pa.int64()),
                pa.array(n, pa.int32()),
                pa.array(prints, pa.int64()),
                pa.array(maps, pa.binary()),
                pa.array(prefixes, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "words_hash", "n", "fp", "bitmap", "prefix"])
        tidy()

    return keyed.mapInArrow(run, "doc_id long, text_hash long, words_hash long, n int, fp long, bitmap binary, prefix array<long>")


def meet(
    tokens: np.ndarray,
    texts: np.ndarray,
    places: np.ndarray,
    sizes: np.ndarray,
    similarity: float,
    salted: tuple[np.ndarray, ...] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of small groups, rows of large groups: token, text, head, size); rows are whole groups sorted by token and text."""
    new = np.ones(len(tokens), bool)  # a text may come from several tasks
    new[1:] = (tokens[1:] != tokens[:-1]) | (texts[1:] != texts[:-1])
    tokens, texts, places, sizes = tokens[new], texts[new], places[new], sizes[new]
    cuts = np.flatnonzero(np.diff(tokens)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(tokens)]])
    counts, names, heads = ends - starts, tokens[starts], np.full(len(starts), -1)
    if salted is not None and len(salted[0]):
        at = np.minimum(np.searchsorted(salted[0], names), len(salted[0]) - 1)
        heads = np.where(salted[0][at] == names, at, -1)
    few = (counts <= PAIRED_GROUP) & (heads < 0)
    small = np.repeat(few, counts)
    left = np.repeat(ends, counts) - np.arange(len(tokens))  # rows of the same group from here on
    pairs = [np.empty((0, 2), np.int64)]

    def enough(at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """If this is the first shingle that both share, they can't share more than what is left from here on."""
        return np.minimum(sizes[at] - places[at], sizes[to] - places[to]) >= similarity / (1 + similarity) * (sizes[at] + sizes[to]) - 1e-6

    for lag in range(1, PAIRED_GROUP):
        at = np.flatnonzero(small & (left > lag))
        if not len(at):
            break
        to = at + lag
        able = enough(at, to)
        pairs.append(np.stack([texts[at[able]], texts[to[able]]], axis=1))
    large = [np.empty((0, 4), np.int64)]
    for k in np.flatnonzero(~few):
        some = np.arange(starts[k], ends[k])
        if heads[k] >= 0:
            token, partner = salted[1][heads[k]], np.full(counts[k], salted[2][heads[k]])
        else:
            token, head = names[k], starts[k] + int(names[k].view(np.uint64) % np.uint64(counts[k]))
            partner = np.where(enough(some, np.full(counts[k], head)), texts[head], texts[some])
        large.append(np.stack([np.full(counts[k], token), texts[some], partner, sizes[some]], axis=1))
    return np.unique(np.concatenate(pairs), axis=0), np.concatenate(large)


def _meetings(texts: DataFrame, order: ShingleOrder, similarity: float) -> DataFrame:
    """token, a, b, n: pairs to verify; in large groups with the token, where each text a (of n shingles) is paired with a head or, if they can't link, itself."""
    salted = order.salted()

    def as_batch(parts: list[np.ndarray]) -> pa.RecordBatch:
        pairs, large = meet(*parts, similarity, salted)
        columns = [
            pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(large[:, 0])]),
            pa.array(np.concatenate([pairs[:, 0], large[:, 1]])),
            pa.array(np.concatenate([pairs[:, 1], large[:, 2]])),
            pa.array(np.concatenate([np.zeros(len(pairs), np.int64), large[:, 3]])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["token", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0  # the last group so far may go on in the next batch
        for batch in batches:
            extent = batch.column("extent").to_numpy(zero_copy_only=False)
            held.append([batch.column("token").to_numpy(zero_copy_only=False), batch.column("text").to_numpy(zero_copy_only=False), extent >> 32, extent & 0xFFFFFFFF])
            rows += batch.num_rows
            if rows < 1 << 18 or held[0][0][0] == held[-1][0][-1]:
                continue
            parts = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(parts[0], parts[0][-1]))
            held, rows = [[c[cut:] for c in parts]], len(parts[0]) - cut
            yield as_batch([c[:cut] for c in parts])
        if rows:
            yield as_batch([np.concatenate(c) for c in zip(*held, strict=True)])
        tidy()

    dealt = texts.select(F.col("words_hash").alias("text"), "n", F.posexplode("prefix").alias("place", "token"))
    dealt = dealt.select("token", "text", (F.shiftleft(F.col("place").cast("long"), 32) + F.col("n")).alias("extent"))
    return dealt.repartition("token").sortWithinPartitions("token", "text").mapInArrow(run, "token long, a long, b long, n long")


def _fingerprint_pairs(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): texts whose fingerprints link, as a forest; texts with one fingerprint hang on one of them."""
    heads = scratch.table(classes.groupBy("fp").agg(F.min("words_hash").alias("head")), "heads")
    links = signature_links(heads.select("fp"), scratch)
    left, right = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab")
    linked = links.join(left, "a").join(right, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    same = classes.join(heads, "fp").where("words_hash <> head").select(F.col("head").alias("a"), F.col("words_hash").alias("b"))
    return linked.unionAll(same)


def _thinned(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, near) of ``pairs`` that the bitmaps of their texts don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb")]
            keep = may_link(*sizes, *[batch.column(c).to_pylist() for c in ("ma", "mb")], similarity)
            yield batch.select(["a", "b", "near"]).filter(pa.array(keep))

    left, right = (classes.select(F.col("words_hash").alias(c), F.col("n").alias(f"n{c}"), F.col("bitmap").alias(f"m{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "near", "na", "nb", "ma", "mb").mapInArrow(run, "a long, b long, near boolean")


def joining_links(sets: list[np.ndarray], labels: np.ndarray, probes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between ``sets`` that join all ``labels`` which any link of a set in ``probes`` joins."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    holders = np.repeat(np.arange(len(sets)), sizes)[order]
    starts = np.searchsorted(ids[order], np.arange(ids.max() + 2))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    labels, links = labels.copy(), []
    for u in probes.tolist():
        own = ids[begins[u] : begins[u + 1]]
        lengths = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        common = np.bincount(holders[at], minlength=len(sets))
        hit = np.flatnonzero((common >= similarity * (sizes[u] + sizes - common)) & (labels != labels[u]))
        if len(hit):
            joined, first = np.unique(labels[hit], return_index=True)
            links += [(u, v) for v in hit[first].tolist()]
            labels[np.isin(labels, joined)] = labels[u]
    return links


def likely(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    """``keyed`` with all rows whose text_hash is one of ``chosen`` (of_hash), and few others while these are fewer than ``LOOKUP_BITS``."""
    bit = lambda c: F.pmod(c, F.lit(LOOKUP_BITS))
    row = lambda c: F.shiftright(bit(F.col(c)), _ROW_BITS.bit_length() - 1).alias("row")
    place = lambda c: F.pmod(F.col(c), F.lit(_ROW_BITS)).cast("int")
    bits = chosen.groupBy(row("of_hash")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place("of_hash"))).alias("bits"))
    return keyed.withColumn("row", row("text_hash")).join(F.broadcast(bits), "row").where(F.getbit("bits", place("text_hash")) == 1).drop("row", "bits")


class _Shingles:
    """Whole shingle sets of the texts that are asked for, read from the documents again."""

    def __init__(self, keyed: DataFrame, classes: DataFrame, scratch: Scratch, shingle_words: int) -> None:
        self.keyed, self.classes, self.scratch, self.shingle_words = keyed, classes, scratch, shingle_words

    def table(self, wanted: DataFrame, name: str) -> DataFrame:
        """words_hash and shingles for the texts in ``wanted`` (words_hash)."""
        size = self.shingle_words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                sets = [shingle_set(shingle_digests(words_of(t), size)) for t in batch.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("words_hash"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))],
                    names=["words_hash", "shingles"],
                )
            tidy()

        chosen = wanted.distinct().join(self.classes.select("words_hash", F.col("text_hash").alias("of_hash"), F.col("doc_id").alias("of_id")), "words_hash")
        chosen = self.scratch.table(chosen, f"{name}-wanted")
        same = (F.col("text_hash") == F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("of_id"))
        texts = likely(self.keyed, chosen).join(chosen, same).dropDuplicates(["words_hash"]).select("words_hash", "text")
        return self.scratch.table(texts.mapInArrow(run, "words_hash long, shingles array<long>"), name)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    left, right = (sets.select(F.col("words_hash").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _open_links(large: DataFrame, roots: DataFrame, shingles: _Shingles, scratch: Scratch, similarity: float) -> DataFrame | None:
    """Links that are still missing in large groups (token, a, n) whose texts are in several components; None if there are no such groups."""
    members = scratch.table(
        large.join(roots, F.col("a") == F.col("node"), "left").select("token", F.col("a").alias("text"), "n", F.coalesce("root", "a").alias("label")).distinct(),
        "members",
    )
    marks = [F.bit_xor(F.xxhash64("text", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]
    labels = members.groupBy("token", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"), *marks)
    largest = F.max(F.struct("c", "n", "label")).alias("largest")
    groups = labels.groupBy("token").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), largest, *[F.bit_xor(f"mark{k}").alias(f"mark{k}") for k in (0, 1)])
    blocks = lambda c, n: F.greatest(F.ceil(c / BLOCK_TEXTS), F.ceil(n / BLOCK_SHINGLES))
    several = groups.where("largest.c < c").select(
        "token", "c", "mark0", "mark1", F.col("largest.label").alias("main"), blocks(F.col("c"), F.col("n")).alias("blocks"), blocks(
            F.expr("c - largest.c"),
            F.expr("n - largest.n"),
        ).alias("probing")
    )
    # shingles with the same texts need one comparison
    several = scratch.table(several.groupBy("c", "mark0", "mark1").agg(F.min(F.struct("token", "main", "blocks", "probing")).alias("g")).select("g.*"), "several")
    if several.isEmpty():
        return None
    maps = shingles.classes.select(F.col("words_hash").alias("text"), "bitmap")
    open_ = members.join(several, "token").join(maps, "text")
    place = lambda n: F.pmod(F.xxhash64("text", "token"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    told = ["text", "label", "n", "bitmap"]
    probes = open_.where("label <> main").select("token", place("probing").alias("x"), every("blocks").alias("y"), *told, F.lit(True).alias("probe"))
    others = open_.select("token", every("probing").alias("x"), place("blocks").alias("y"), *told, F.lit(False).alias("probe"))

    def thin(cell: pa.Table) -> pa.Table:
        sizes, labels, probe = (cell.column(c).to_numpy() for c in ("n", "label", "probe"))
        live = possible_partners(sizes, cell.column("bitmap").to_pylist(), labels, np.flatnonzero(probe), np.flatnonzero(~probe), similarity)
        return cell.select(["token", "x", "y", "text", "label", "probe"]).filter(pa.array(live))

    def run(cell: pa.Table) -> pa.Table:
        flat = cell.column("shingles").combine_chunks()
        ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
        shingles = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        texts, labels = cell.column("text").to_numpy(), cell.column("label").to_numpy()
        probing = np.flatnonzero(cell.column("probe").to_numpy())
        links = np.array(joining_links(shingles, labels, probing, similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(texts[links[:, 0]]), "b": pa.array(texts[links[:, 1]])})

    cells = probes.unionAll(others).groupBy("token", "x", "y")
    live = scratch.table(cells.applyInArrow(thin, "token long, x long, y long, text long, label long, probe boolean"), "open-texts")
    if live.isEmpty():
        return None
    sets = shingles.table(live.select(F.col("text").alias("words_hash")), "open-shingles")
    scratch.release()
    cells = live.join(sets.withColumnRenamed("words_hash", "text"), "text").select("token", "x", "y", "text", "label", "probe", "shingles")
    return scratch.table(cells.groupBy("token", "x", "y").applyInArrow(run, "a long, b long"), "open-links")


def similar_groups(docs: DataFrame, scratch: Scratch, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, copies (rows with both) and group: one row per distinct id and text, ``group`` by links."""
    keyed = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    order = _shingle_order(keyed, shingle_words)
    sketched = scratch.table(_sketches(keyed, order, shingle_words, similarity), "sketches")
    texts = sketched.where("prefix is not null")
    met = scratch.table(_meetings(texts, order, similarity), "met")
    scratch.release()
    classes = scratch.table(texts.select("words_hash", "doc_id", "text_hash", "n", "fp", "bitmap").dropDuplicates(["words_hash"]), "classes")
    near = _fingerprint_pairs(classes, scratch).withColumn("near", F.lit(True))
    other = met.where("a <> b").select("a", "b", F.lit(False).alias("near"))
    pairs = near.unionByName(other).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("near").alias("near"))
    candidates = scratch.table(_thinned(pairs, classes, similarity), "candidates")
    scratch.release()
    shingles = _Shingles(keyed, classes, scratch, shingle_words)
    sets = shingles.table(candidates.select(F.explode(F.array("a", "b")).alias("words_hash")), "shingles")
    roots = scratch.table(components(scratch.table(_verified(candidates.where("near"), sets, similarity), "near-links"), scratch), "near-roots")
    label_a, label_b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    labelled = candidates.where("not near").join(label_a, "a", "left").join(label_b, "b", "left")
    apart = scratch.table(labelled.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "apart")
    as_links = lambda r: r.select(F.col("node").alias("a"), F.col("root").alias("b"))
    further = scratch.table(_verified(apart, sets, similarity), "further-links")
    if not further.isEmpty():
        roots = scratch.table(components(as_links(roots).unionAll(further), scratch), "roots")
    scratch.drop("shingles")
    scratch.release()
    missing = _open_links(met.where("token is not null").select("token", "a", "n"), roots, shingles, scratch, similarity)
    if missing is not None and not missing.isEmpty():
        roots = components(as_links(roots).unionAll(missing), scratch)
    members = sketched.groupBy("doc_id", "text_hash", "words_hash").agg(F.count("*").alias("copies"))
    return members.join(roots, members["words_hash"] == roots["node"], "left").select("doc_id", "text_hash", "copies", F.coalesce("root", "words_hash").alias("group"))


def keep_one_of_each(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id (a null one only if there is no other), then the smallest text hash, then the smallest row as JSON."""
    parts = Scratch(scratch.spark, "similar-groups")
    groups = scratch.table(similar_groups(docs, parts, **options), "groups")
    delete_path(scratch.spark, parts.path)
    scratch.release()
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "copies")).alias("f"))
    keep = scratch.table(first.select(F.col("f.doc_id").alias("keep_id"), F.col("f.text_hash").alias("keep_hash"), F.col("f.copies").alias("copies")), "keep")
    packed = docs.select(F.struct("*").alias("doc"))  # whatever the columns' names are
    doc = F.col("doc")
    same = doc["doc_id"].eqNullSafe(F.col("keep_id")) & (F.xxhash64(F.coalesce(doc["text"], F.lit(""))) == F.col("keep_hash"))
    once = packed.join(keep.where("copies = 1"), same).select("doc")
    repeated = packed.join(keep.where("copies > 1"), same).groupBy("keep_id", "keep_hash").agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc")
    return once.unionAll(repeated).select(*[doc[c].alias(c) for c in docs.columns])
