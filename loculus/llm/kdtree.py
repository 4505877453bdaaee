"""Sharding by a k-d tree over document metadata.

Starting from one node that holds all documents, every node is split at a
weighted median (bytes are the weights) of its widest metadata dimension until
each leaf holds its share of the bytes.  A node that has to give ``k`` shards
gives ``k // 2`` of them to its left child, so any number of shards works; with
a byte target the number of leaves follows from the total.

A level of the tree is split together.  Medians are found by Spark: one
aggregation counts bytes in ``STEPS`` equal steps of every node's box, the step
that holds the median becomes the next range, and the search ends once that step
holds next to nothing of a leaf's bytes.  Rows never come to the driver, only one
row per node and round does.  A level's splits are a small table (one row per
node, broadcast: ``MOST_NODES`` bounds it) that moves every document to its child,
and the narrow table of metadata is stored again, so plans stay as small for
100,000 leaves as for two.

Each dimension is a 27-bit position (the document's id, the logarithm of its
size, hashes of source and language) followed by 18 hash bits of the document
and 18 of its stored row number, so a value that many documents share, such as a
hot source, is cut like any other, and so are rows that are equal.

Edge cases: a null text weighs the fixed bytes of a record; null ids, sources and
languages stand first in their dimension; equal rows may come to different
shards; with fewer rows than shards some stay empty; an empty table gives an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.llm.common import Scratch

#: Bytes that a record takes besides its text.
RECORD_BYTES = 8
#: Steps of one round's histogram for a node, and the share of a leaf's bytes that the last step may hold.
STEPS, LEAST_SHARE = 4096, 1e-4
#: Rows that one numbering task should hold.
SLOT_ROWS = 200_000
#: Leaves of a tree at most: a level's nodes are broadcast.
MOST_NODES = 1 << 20
_POSITION_BITS, _TIE_BITS = 27, 18
DIMENSIONS = ("k_id", "k_size", "k_source", "k_lang")


@dataclass
class _Node:
    """A node that gives ``shards`` leaves from ``first_shard`` on; ``low`` and ``high`` are its box, both inclusive."""

    shards: int
    first_shard: int
    size: int
    low: list[int]
    high: list[int]
    # the search for the median: the range that holds it, bytes before the range and in it
    dimension: int = 0
    range: tuple[int, int] = (0, 0)
    before: int = 0
    inside: int = 0

    @property
    def goal(self) -> float:
        return self.size * (self.shards // 2) / self.shards

    def searches(self) -> bool:
        return self.range[0] < self.range[1] and self.inside > LEAST_SHARE * self.size / self.shards


def document_metadata(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, size, text_crc32, row and one long per dimension; the texts are read once, here."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
        *[
            F.crc32(
                F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
            ).alias(f"h_{c}") if c in docs.columns else F.lit(0).cast("long").alias(f"h_{c}") for c in ("source", "lang")
        ],
    )
    narrow = scratch.table(narrow, "narrow")
    low, high, big = narrow.agg(F.min("doc_id"), F.max("doc_id"), F.max("size")).first()
    low, high, big = low or 0, high or 0, big or 1
    bits = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 64 - _TIE_BITS)
    tie = F.shiftleft(bits("doc_id", "size", "text_crc32"), _TIE_BITS) + bits("row")
    id_place = (F.coalesce(F.col("doc_id"), F.lit(low)).cast("double") - low) / float(max(1, high - low))

    def place(unit: Column) -> Column:
        return F.shiftleft((unit * ((1 << _POSITION_BITS) - 1)).cast("long"), 2 * _TIE_BITS) + tie

    return narrow.select(
        "doc_id",
        "size",
        "text_crc32",
        "row",
        place(id_place).alias("k_id"),
        place(F.log("size") / F.log(F.lit(float(big) + 1))).alias("k_size"),
        place(F.col("h_source") / float(1 << 32)).alias("k_source"),
        place(F.col("h_lang") / float(1 << 32)).alias("k_lang"),
    )


def _narrow_ranges(rows: DataFrame, nodes: dict[int, _Node]) -> None:
    """One round for the nodes given: their range becomes the step that holds their median."""
    spark = rows.sparkSession
    state = [(k, n.dimension, n.range[0], n.range[1], (n.range[1] - n.range[0]) // STEPS + 1, float(n.goal - n.before)) for k, n in nodes.items()]
    table = F.broadcast(spark.createDataFrame(state, "node int, dimension int, low long, high long, width long, goal double"))  # one row per node
    key = F.element_at(F.array(*DIMENSIONS), F.col("dimension") + 1)
    inside = rows.join(table, "node").withColumn("key", key).where(F.col("key").between(F.col("low"), F.col("high")))
    steps = inside.groupBy("node", F.expr("(key - low) div width").alias("step")).agg(
        F.sum("size").alias("bytes"),
        F.min("key").alias("low"),
        F.max("key").alias("high"),
        F.first("goal").alias("goal"),
    )
    upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("step"))
    hit = steps.withColumn("upto", upto).where((F.col("upto") - F.col("bytes") <= F.col("goal")) & (F.col("goal") <= F.col("upto")))
    # where two steps touch the goal the first one counts
    found = hit.groupBy("node").agg(F.min_by(F.struct("low", "high", "upto", "bytes"), "step").alias("s")).select("node", "s.*").collect()
    for r in found:
        n = nodes[r["node"]]
        n.range, n.before, n.inside = (r["low"], r["high"]), n.before + r["upto"] - r["bytes"], r["bytes"]


def _children(nodes: dict[int, _Node], rows: DataFrame) -> tuple[dict[int, _Node], list[tuple[int, int, int]]]:
    """Split the nodes that still have to give several shards: their children by number, and (node, dimension, split)."""
    wide = {k: n for k, n in nodes.items() if n.shards > 1}
    for n in wide.values():
        n.dimension = max(range(len(DIMENSIONS)), key=lambda d: n.high[d] - n.low[d])
        n.range, n.before, n.inside = (n.low[n.dimension], n.high[n.dimension]), 0, n.size
    while searching := {k: n for k, n in wide.items() if n.searches()}:
        _narrow_ranges(rows, searching)
    out, splits = {k: n for k, n in nodes.items() if n.shards == 1}, []
    for k, n in wide.items():
        after = n.before + n.inside - n.goal < n.goal - n.before  # which end of the last step is nearer
        split = n.range[1] + 1 if after else n.range[0]
        left = n.before + (n.inside if after else 0)
        half, d = n.shards // 2, n.dimension
        low, high = list(n.low), list(n.high)
        high[d], low[d] = split - 1, split
        out[2 * k] = _Node(half, n.first_shard, left, n.low, high)
        out[2 * k + 1] = _Node(n.shards - half, n.first_shard + half, n.size - left, low, n.high)
        splits.append((k, d, split))
    return out, splits


def kd_shards(docs: DataFrame, scratch: Scratch, shards: int | None = 24, target_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    ``target_bytes`` sets the number of shards from the total instead.  Slots
    number a shard's documents from 0 without gaps, in an order that is the
    same in each run over the same files.
    """
    rows = scratch.table(document_metadata(docs, scratch).withColumn("node", F.lit(1)), "level-0")
    scratch.drop("narrow")
    total, count, *box = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), *[f(k) for f in (F.min, F.max) for k in DIMENSIONS]).first()
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    if shards > MOST_NODES:
        raise ValueError(f"{shards} shards are more than {MOST_NODES}")
    low, high = [x or 0 for x in box[: len(DIMENSIONS)]], [x or 0 for x in box[len(DIMENSIONS) :]]
    nodes, level = {1: _Node(shards, 0, total, low, high)}, 0
    while any(n.shards > 1 for n in nodes.values()):
        nodes, splits = _children(nodes, rows)
        table = F.broadcast(rows.sparkSession.createDataFrame(splits, "node int, dimension int, split long"))  # one row per node
        side = F.when(F.element_at(F.array(*DIMENSIONS), F.col("dimension") + 1) >= F.col("split"), 1).otherwise(0)
        moved = rows.join(table, "node", "left").withColumn("node", F.when(F.col("split").isNull(), F.col("node")).otherwise(2 * F.col("node") + side).cast("int"))
        level += 1
        rows = scratch.table(moved.drop("dimension", "split"), f"level-{level}")
        scratch.drop(f"level-{level - 1}")
    leaves = F.broadcast(rows.sparkSession.createDataFrame([(k, n.first_shard) for k, n in nodes.items()], "node int, shard int"))  # one row per shard
    blocks = max(8, count // (shards * SLOT_ROWS))
    placed = rows.join(leaves, "node").select(
        "doc_id",
        "size",
        "text_crc32",
        "row",
        "shard",
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "row"), F.lit(blocks)).alias("block"),
    )
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "block").count().withColumn("start", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32", "row"))
    return placed.withColumn("inside", inside).join(starts, ["shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("start") + F.col("inside") - 1).cast("long").alias("slot"),
    )
