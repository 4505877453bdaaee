"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint of 64 bits has two segments of 32 bits.  Fingerprints that differ
in at most three bits differ in at most one bit of one of the segments, so each
fingerprint is indexed under 64 signatures: one segment with one of its bits
wildcarded.  Fingerprints meet where signatures are equal; candidates are
verified on all 64 bits.

Copies share a fingerprint and collapse to one row before signatures are made,
by an aggregation with map-side combination.  Signatures that more than
``MOST_TOGETHER`` fingerprints have are counted (with map-side combination) before
anything is gathered, and split: fingerprints of such a group differ only in the
other segment and the wildcard, so they are indexed again under one-wildcard
variants of that segment's halves, and where need be of quarters.  Then eleven
bits are left, so no group that reaches a task can hold more than 2,048.  Groups
are met in sorted streams.  A small group's verified pairs are emitted once (only
under the first signature that a pair shares); a larger group gives a spanning
forest of its links instead of all pairs, so output does not grow with the square
of a group.  Components are joined up by Spark (see ``graph``).

Edge cases: a null or empty text has fingerprint zero and links like any other;
a text with fewer words than a shingle is one shingle; repeated rows and copies get the same
component; a null doc_id is never a component's id unless all its ids are null;
an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import Scratch
from loculus.llm.files import slices, tidy
from loculus.llm.graph import components

#: Words of a shingle, seed of its hash, and differing bits that still link.
SHINGLE_WORDS = 3
HASH_SEED = 42
MOST_BITS = 3
#: Groups up to this size are compared pair by pair at once; larger ones give forests.
PAIRED_GROUP = 16
#: Forests of up to so many fingerprints are found by comparing them in blocks.
FOREST_BLOCK = 2048
#: Signature groups of more fingerprints are split before they are gathered.
MOST_TOGETHER = 2048
#: Crowded signatures are broadcast up to this number (one long each), and joined beyond it.
FEW_SIGNATURES = 100_000
_BLOCK = 1 << 18


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lowered, as bytes: only A-Z change, only ASCII white space splits."""
    return (text or "").encode().lower().split()


def shingle_digests(words: list[bytes], shingle_words: int = SHINGLE_WORDS) -> bytes:
    """XXH64 digests (big-endian, 8 bytes each) of a text's shingles in order; fewer words are one shingle, none give none."""
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        starts, ends = [0], [len(joined)]
    else:
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        ends = stops[shingle_words - 1 :].tolist()
        starts = [0, *(stops[: len(words) - shingle_words] + 1).tolist()]
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends, strict=True)])


def majority_bits(digests: bytes) -> int:
    """The unsigned number whose bits are those set in over half of the digests."""
    raw, counts = np.frombuffer(digests, np.uint8), np.zeros(64, np.int64)
    for at in range(0, len(raw), 8 * _BLOCK):
        bits = np.unpackbits(raw[at : at + 8 * _BLOCK]).reshape(-1, 64)
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        if whole:
            counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(raw) // 8).tobytes(), "big")


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint: a bit is 1 if it is set in over half of the shingles' hashes."""
    return majority_bits(shingle_digests(words_of(text), shingle_words))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle_words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def forest(fps: np.ndarray, free: list[int], most: int = MOST_BITS) -> list[np.ndarray]:
    """Links (rows of two fingerprints) that connect distinct ``fps`` just as all links within ``most`` bits do.

    ``free`` are the bits in which ``fps`` may differ.
    """
    if len(fps) < 2:
        return []
    if len(fps) > FOREST_BLOCK and len(free) > 8 and most <= MOST_BITS:
        # within three bits at most one differs in one of the halves; beyond, no piece is left that is worth indexing, and blocks are compared
        links = []
        for half in (free[: len(free) // 2], free[len(free) // 2 :]):
            rest = [b for b in free if b not in half]
            for wild in half:
                mask = np.uint64(sum(1 << b for b in half if b != wild))
                key = fps & mask
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.diff(key[order])) + 1
                for group in np.split(fps[order], cuts):
                    if len(group) > 1:
                        links += forest(group, [*rest, wild], most)
        return links
    links, waiting = [], fps
    while len(waiting):
        front, waiting = waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            head, front = front[:64], front[64:]
            near = np.bitwise_count(head[:, None] ^ waiting[None, :]) <= most
            hit = near.any(axis=0)
            if hit.any():
                links.append(np.stack([head[near[:, hit].argmax(axis=0)], waiting[hit]], axis=1))
                front, waiting = np.concatenate([front, waiting[hit]]), waiting[~hit]
    return links


def _first_shared(difference: np.ndarray) -> np.ndarray:
    """Number of the first signature that two fingerprints with this difference share (64: none)."""
    high, low = difference >> np.uint64(32), difference & np.uint64(0xFFFFFFFF)
    place = lambda seg: np.log2(np.maximum(seg, 1).astype(np.float64)).astype(np.int64)  # noqa: E731  of a single bit
    return np.where(np.bitwise_count(high) <= 1, place(high), np.where(np.bitwise_count(low) <= 1, 32 + place(low), 64))


def link_groups(signatures: np.ndarray, fps: np.ndarray, most: int = MOST_BITS, first_level: bool = True) -> np.ndarray:
    """Links of whole signature groups, given sorted by signature and without repeats.

    Signatures of the first level hold their number, by which a pair is emitted
    under the first one that it shares only.
    """
    links = [np.empty((0, 2), np.uint64)]
    cuts = np.flatnonzero(np.diff(signatures)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
    sizes = ends - starts
    small = np.repeat(sizes <= PAIRED_GROUP, sizes)
    left = np.repeat(ends, sizes) - np.arange(len(fps))  # rows of the same group from here on
    for lag in range(1, PAIRED_GROUP):
        at = np.flatnonzero(small & (left > lag))
        if not len(at):
            break
        a, b = fps[at], fps[at + lag]
        keep = np.bitwise_count(a ^ b) <= most
        if first_level:
            keep &= _first_shared(a ^ b) == signatures[at] >> 32
        links.append(np.stack([a[keep], b[keep]], axis=1))
    for k in np.flatnonzero(sizes > PAIRED_GROUP):
        free = range(64)
        if first_level:
            number = int(signatures[starts[k]] >> 32)
            free = [*(range(32) if number < 32 else range(32, 64)), 32 + number if number < 32 else number - 32]
        links += forest(fps[starts[k] : ends[k]], list(free), most)
    return np.concatenate(links)


def _cleared(bits: Column, wild: Column) -> Column:
    """``bits`` with the bit numbered ``wild`` cleared."""
    return bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), wild.cast("int"))))


def _split(hot: DataFrame, level: int) -> DataFrame:
    """``hot`` (signature, path, fp) once for every one-wildcard variant of the two halves of what is still free.

    ``path`` holds the number of the variant at each level so far: 64 variants
    of segments, 32 of the other segment's halves, 16 of the other half's quarters.
    """
    width = 32 >> level  # bits of a piece at this level
    number = F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))).alias("number")
    base = F.when(F.col("path")[0] < 32, F.lit(0)).otherwise(F.lit(32))  # the segment that is still free
    if level == 2:
        base = base + F.when(F.col("path")[1] < 16, F.lit(0)).otherwise(F.lit(16))
    opened = hot.select("signature", "path", "fp", number)
    shift = base + F.when(F.col("number") < width, F.lit(width)).otherwise(F.lit(0))
    piece = F.call_function("shiftrightunsigned", F.col("fp"), shift.cast("int")).bitwiseAND(F.lit((1 << width) - 1))
    value = _cleared(piece, F.pmod("number", F.lit(width)))
    return opened.select(F.xxhash64("signature", "number", value).alias("signature"), F.concat("path", F.array("number")).alias("path"), "fp")


def signature_links(distinct: DataFrame, scratch: Scratch, most: int = MOST_BITS, most_together: int = MOST_TOGETHER) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` as all links within ``most`` (at most 3) bits do."""
    numbered = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("number"))
    segment = F.when(F.col("number") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    cleared = _cleared(segment, F.pmod("number", F.lit(32)))
    signed = numbered.select((F.shiftleft(F.col("number").cast("long"), 32) + cleared).alias("signature"), F.array("number").alias("path"), "fp")

    def linker(first_level: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_s, open_f = [], []  # the last group so far may go on in the next batch
            for batch in batches:
                s = batch.column("signature").to_numpy(zero_copy_only=False)
                f = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                open_s.append(s)
                open_f.append(f)
                if s[0] == s[-1]:
                    continue
                s, f = np.concatenate(open_s), np.concatenate(open_f)
                cut = int(np.searchsorted(s, s[-1]))
                open_s, open_f = [s[cut:]], [f[cut:]]
                yield as_batch(link_groups(s[:cut], f[:cut], most, first_level))
            if open_s:
                yield as_batch(link_groups(np.concatenate(open_s), np.concatenate(open_f), most, first_level))
            tidy()

        return run

    def as_batch(links: np.ndarray) -> pa.RecordBatch:
        pairs = np.ascontiguousarray(links.T).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    found = None
    for level in range(3):
        counts = signed.groupBy("signature").agg(F.count("*").alias("n")).where(F.col("n") > most_together)
        crowded = scratch.table(counts.select("signature"), f"crowded-{level}") if level < 2 else None
        hot = crowded.count() if level < 2 else 0
        if hot:
            marks = crowded.withColumn("hot", F.lit(True))
            marked = signed.join(F.broadcast(marks) if hot <= FEW_SIGNATURES else marks, "signature", "left")
            groups = marked.where("hot is null")
        else:
            groups = signed
        links = groups.select("signature", "fp").repartition("signature").sortWithinPartitions("signature", "fp").mapInArrow(linker(level == 0), "a long, b long")
        found = links if found is None else found.unionAll(links)
        if not hot:
            break
        signed = scratch.table(_split(marked.where("hot"), level + 1).distinct(), f"split-{level + 1}")
    return found


def near_duplicates(docs: DataFrame, scratch: Scratch, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach."""
    fps = scratch.table(fingerprints(docs, shingle_words), "fingerprints")
    classes = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(signature_links(classes.select("fp"), scratch), scratch)
    labelled = scratch.table(
        classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "labelled"
    )
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
