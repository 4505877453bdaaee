"""The prefix trie of conversations: a Cartesian tree over the sorted conversations.

Turns are named by 128-bit digests of role and text, and conversations that are
equal turn by turn become one class.  Classes are sorted by their turns: runs of
``RUN`` turns are numbered in their own sorted order, so a conversation is a short
array of run numbers, and the longest common prefix (LCP) with its predecessor is
found in the first run that differs.  Over the array of these lengths the nearest
smaller values to either side give every branching of the trie as an interval of
classes: tasks find them inside blocks with a stack, and what a block can't answer
goes by the blocks' minima to the block that can, whose falling chain of values
holds the place.  Equal intervals are merged, depths between a branching and the
next one above it are filled in, and sums, minima and leaf counts of an interval
come from running sums and from minima of blocks, block heads and block tails.

No conversation, class or interval is gathered in one task as rows: a long
conversation is spread over its turns and runs, a large class is a count and a
minimum, and its ids are hashed as a stream of pieces.  The driver sees one number
for each block of ``BLOCK`` classes.

Edge cases: turns are ordered by number (null first), then by the first characters
of role and text, then by digest; equal rows are turns of their own; a null role or
text is empty; rows without a conversation id belong to none; ids may be negative
(``%`` keeps the sign); conversations without turns are members of the root; an
empty table has no conversation and gives no node.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.llm.common import Scratch, word_count

#: Turns of a run, classes of a block, ids of a piece that is hashed, depths that are filled in together.
RUN, BLOCK, PIECE, FILL = 256, 1 << 16, 4096, 4096
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def _spread_positions(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, pos, sym, words, run_words): turns of a conversation numbered from 1, with words summed up to each.

    Turns are range-sorted, so a long conversation lies in several partitions; counts and sums of a conversation's
    earlier partitions are added to what is counted inside one.
    """
    said = F.concat(F.coalesce(F.col("role"), F.lit("")), F.lit("\0"), F.coalesce(F.col("text"), F.lit("")))
    named = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn"),
        F.substring(said, 1, 48).alias("start"),
        F.unhex(F.md5(F.concat(F.length(F.coalesce(F.col("role"), F.lit(""))).cast("string"), F.lit(":"), said))).alias("sym"),
        word_count(F.col("text")).alias("words"),
    )
    order = ["conv", F.asc_nulls_first("turn"), "start", "sym"]
    kept = scratch.table(named.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "sym", "words", F.monotonically_increasing_id().alias("at")), "turns")
    part = F.shiftright("at", 33).alias("part")
    sums = kept.groupBy("conv", part).agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("words").alias("w"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = sums.select("conv", "part", "first", earlier("n").alias("n_before"), earlier("w").alias("w_before"))
    inside = Window.partitionBy("conv", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("part", part).join(offsets, ["conv", "part"]).select(
        "conv", (F.col("at") - F.col("first") + 1 + F.col("n_before")).alias("pos"), "sym", "words", (F.sum("words").over(inside) + F.col("w_before")).alias("run_words")
    )


def rebuild(turns: DataFrame, scratch: Scratch, family: int = 20, most_shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the head of their family: (conv, pos, sym, words, run_words), and (conv, length).

    Conversation c takes the first h turns of c - c % family, h = crc32(c) % most_shared, then its own turns after its first h.
    """
    own = scratch.table(_spread_positions(turns, scratch), "own")
    scratch.drop("turns")
    convs = own.groupBy("conv").agg(F.count("*").alias("own_length"))
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % most_shared
    head = own.where(F.col("pos") < most_shared).withColumnRenamed("conv", "head")
    asked = convs.withColumns({"h": shared, "head": F.col("conv") - F.col("conv") % family})
    begun = asked.join(head, (asked["head"] == head["head"]) & (F.col("pos") <= F.col("h"))).select("conv", "pos", "sym", "words", "run_words")
    lead = begun.groupBy("conv").agg(F.count("*").alias("lead"), F.max("run_words").alias("lead_words"))
    skipped = own.withColumn("h", shared).where(F.col("pos") <= F.col("h")).groupBy("conv").agg(F.max("run_words").alias("skipped_words"))
    shift = convs.withColumn("h", shared).join(lead, "conv", "left").join(skipped, "conv", "left").na.fill(0)
    rest = own.join(shift, "conv").where(F.col("pos") > F.col("h")).select(
        "conv", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "sym", "words", (F.col("run_words") - F.col("skipped_words") + F.col("lead_words")).alias("run_words")
    )
    built = scratch.table(begun.unionByName(rest), "built")
    lengths = scratch.table(shift.select("conv", (F.col("lead") + F.greatest(F.col("own_length") - F.col("h"), F.lit(0))).alias("length")), "lengths")
    return built, lengths


def _classes(built: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, class, length): equal conversations have one class, named by their smallest id."""
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "pos", "sym").cast("decimal(38,0)"))
    marked = built.groupBy("conv").agg(mark(1).alias("one"), mark(2).alias("two"))
    alike = lengths.join(marked, "conv", "left").na.fill(0, ["one", "two"])
    first = alike.groupBy("length", "one", "two").agg(F.min("conv").alias("class"))
    return alike.join(first, ["length", "one", "two"]).select("conv", "class", "length")


def _numbered(frame: DataFrame, scratch: Scratch, name: str, *order: str) -> DataFrame:
    """The frame with ``i``: its rows' numbers from 0 in the order of the columns."""
    kept = scratch.table(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    part = F.shiftright("at", 33)
    sizes = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    offsets = sizes.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return kept.withColumn("part", part).join(offsets, "part").withColumn("i", F.col("at") - F.col("first") + F.col("before")).drop("part", "first", "before", "at")


def _running(frame: DataFrame, rows_a_block: int, **sums: Column) -> DataFrame:
    """The frame (with ``i`` from 0, no gaps) with running sums up to each row, by blocks of rows."""
    block = F.floor(F.col("i") / rows_a_block).alias("block")
    totals = frame.groupBy(block).agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("block", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in sums))
    inside = Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = frame.withColumn("block", block).join(totals, "block").withColumns({k: F.sum(v).over(inside) + F.col(f"{k}_before") for k, v in sums.items()})
    return found.drop("block", *(f"{k}_before" for k in sums))


def sorted_classes(built: DataFrame, classes: DataFrame, scratch: Scratch, run: int = RUN) -> DataFrame:
    """(i, class, length, n, lcp): classes in the order of their turns, with the LCP of each and the one before (-1 for the first)."""
    sizes = classes.groupBy("class", "length").agg(F.count("*").alias("n"))
    turns = built.join(sizes.select(F.col("class").alias("conv")), "conv", "left_semi")
    in_order = lambda by, what: F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[what])
    runs = scratch.table(turns.groupBy("conv", F.floor((F.col("pos") - 1) / run).alias("run")).agg(in_order("pos", "sym").alias("syms")), "runs")
    names = scratch.table(_numbered(runs.select("syms").distinct(), scratch, "names", "syms").select("syms", F.col("i").alias("name")), "names")
    arrays = runs.join(names, "syms").groupBy("conv").agg(in_order("run", "name").alias("names"))
    keyed = sizes.join(arrays.withColumnRenamed("conv", "class"), "class", "left").withColumn("names", F.coalesce("names", F.array().cast("array<long>")))
    ranked = scratch.table(_numbered(keyed, scratch, "classes", "names"), "ranked")
    earlier = ranked.select((F.col("i") + 1).alias("i"), F.col("names").alias("others"))
    equal = lambda x, y: F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), False) - 1
    pairs = ranked.join(earlier, "i", "left").withColumn("run", equal("names", "others"))
    pairs = pairs.withColumns({"mine": F.get("names", F.col("run")), "theirs": F.get("others", F.col("run"))})
    one, other = (names.select(F.col("name").alias(k), F.col("syms").alias(f"{k}_syms")) for k in ("mine", "theirs"))
    met = pairs.join(one, "mine", "left").join(other, "theirs", "left")
    inside = F.coalesce(equal("mine_syms", "theirs_syms"), F.lit(0))
    return met.select("i", "class", "length", "n", F.when(F.col("i") == 0, -1).otherwise(F.col("run") * run + inside).cast("long").alias("lcp"))


SMALLER = "i long, lcp long, left long, right long, low long, head long, tail long"
CHAIN = "side int, block long, at long, value long"


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the last smaller value before and of the first smaller value after each; -1 and the length where there is none."""
    n = len(values)
    left, right = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    stack: list[int] = []
    line = values.tolist()
    for k, v in enumerate(line):
        while stack and line[stack[-1]] > v:
            right[stack.pop()] = k
        # an equal value above shares its left neighbour
        left[k] = (left[stack[-1]] if line[stack[-1]] == v else stack[-1]) if stack else -1
        stack.append(k)
    return left, right


def _range_minimum(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minima of ``values[first..last]`` (both included) from a table of minima over powers of two."""
    levels = [values]
    while 1 << len(levels) <= len(values):
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), np.int64)
    for k in np.unique(level).tolist():
        at = level == k
        out[at] = np.minimum(levels[k][first[at]], levels[k][last[at] - (1 << k) + 1])
    return out


def _inside_block(table: pa.Table) -> pa.Table:
    """What a block knows by itself of its values: null where the answer lies in another block."""
    table = table.combine_chunks().sort_by("i")
    i, lcp, name = (table.column(c).to_numpy().astype(np.int64) for c in ("i", "lcp", "class"))
    left, right = nearest_smaller(lcp)
    here = (left >= 0) & (right < len(i))
    low = np.zeros(len(i), np.int64)
    low[here] = _range_minimum(name, left[here], right[here] - 1)
    return pa.table({
        "i": i,
        "lcp": lcp,
        "left": pa.array(i[0] + left, mask=left < 0),
        "right": pa.array(i[0] + right, mask=right == len(i)),
        "low": pa.array(low, mask=~here),
        "head": np.minimum.accumulate(name),
        "tail": np.minimum.accumulate(name[::-1])[::-1].copy(),
    })


def _chains(table: pa.Table) -> pa.Table:
    """A block's falling values seen from behind (side 0) and from before (side 1), one row for each distinct value."""
    table = table.combine_chunks().sort_by("i")
    i, lcp = (table.column(c).to_numpy().astype(np.int64) for c in ("i", "lcp"))
    out = []
    for side, (at, value) in enumerate(((i[::-1], lcp[::-1]), (i, lcp))):
        low = np.minimum.accumulate(value)
        first = np.flatnonzero(np.append(True, low[1:] < low[:-1]))
        out.append((np.full(len(first), side), np.full(len(first), table.column("block")[0].as_py()), at[first], value[first]))
    side, block, at, value = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"side": pa.array(side, pa.int32()), "block": block, "at": at, "value": value})


def _across_blocks(smaller: DataFrame, chains: DataFrame, rows: int, rows_a_block: int) -> DataFrame:
    """Fill the answers in that lie in other blocks: the nearest block whose minimum is smaller, then its chain."""
    blocks = -(-rows // rows_a_block)
    minima = np.full(blocks, np.iinfo(np.int64).max)
    for r in chains.groupBy("block").agg(F.min("value").alias("low")).collect():
        minima[r.block] = r.low
    asked = []
    for side, column in ((0, "left"), (1, "right")):
        lone = smaller.where(F.col(column).isNull() & (F.col("lcp") >= 0)).select(F.floor(F.col("i") / rows_a_block).alias("from"), "lcp").distinct()
        asked.append(lone.withColumn("side", F.lit(side)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target = []
            for at, value, side in zip(*(batch.column(c).to_pylist() for c in ("from", "lcp", "side")), strict=True):
                near = np.flatnonzero(minima[:at] < value) if side == 0 else at + 1 + np.flatnonzero(minima[at + 1 :] < value)
                target.append(int(near[-1 if side == 0 else 0]) if len(near) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("from", "lcp", "side")), pa.array(target, pa.int64())], ["from", "lcp", "side", "block"])

    wanted = asked[0].unionAll(asked[1]).mapInArrow(find, "from long, lcp long, side int, block long")
    met = wanted.join(chains, ["side", "block"]).where(F.col("value") < F.col("lcp"))
    place = F.when(F.col("side") == 0, F.col("last")).otherwise(F.col("first")).alias("place")
    answers = met.groupBy("from", "lcp", "side").agg(F.max("at").alias("last"), F.min("at").alias("first")).select("from", "lcp", "side", place)
    keyed = smaller.withColumn("from", F.floor(F.col("i") / rows_a_block))
    for side, column in ((0, "left"), (1, "right")):
        mine = answers.where(F.col("side") == side).select("from", "lcp", F.col("place").alias("found"))
        keyed = keyed.join(mine, ["from", "lcp"], "left").withColumn(column, F.coalesce(column, "found")).drop("found")
    return keyed.drop("from").withColumn("right", F.coalesce("right", F.lit(rows)))


def _block_minimum(nodes: DataFrame, seen: DataFrame, rows: int, rows_a_block: int) -> DataFrame:
    """Add ``low``, the smallest class of [left, last], where a block hasn't found it: tail, whole blocks between, head."""
    blocks = -(-rows // rows_a_block)
    whole = np.full(blocks, np.iinfo(np.int64).max)
    for r in seen.groupBy(F.floor(F.col("i") / rows_a_block).alias("block")).agg(F.min("head").alias("low")).collect():
        whole[r.block] = r.low

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (batch.column(c).to_numpy() // rows_a_block for c in ("left", "last"))
            lows = np.full(len(first), np.iinfo(np.int64).max)
            gap = np.flatnonzero(last - first > 1)
            if len(gap):
                lows[gap] = _range_minimum(whole, first[gap] + 1, last[gap] - 1)
            yield pa.RecordBatch.from_arrays([batch.column("left"), batch.column("last"), batch.column("lcp"), pa.array(lows)], ["left", "last", "lcp", "between"])

    open_ = nodes.where(F.col("low").isNull()).drop("low").mapInArrow(between, "left long, last long, lcp long, between long")
    tail, head = seen.select(F.col("i").alias("left"), "tail"), seen.select(F.col("i").alias("last"), "head")
    same = F.floor(F.col("left") / rows_a_block) == F.floor(F.col("last") / rows_a_block)
    # an interval inside one block is open only where the block's end closes it: its tail is the answer
    closed = open_.join(tail, "left").join(head, "last").select("left", "last", "lcp", F.when(same, F.col("tail")).otherwise(F.least("tail", "head", "between")).alias("low"))
    return nodes.where(F.col("low").isNotNull()).select("left", "last", "lcp", "low").unionByName(closed)


def _member_hashes(classes: DataFrame) -> DataFrame:
    """(class, ends): SHA-256 of the ids of a class in ascending order, comma-joined, as a stream of pieces."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, first = None, [], 0
        for batch in batches:
            for c, conv in zip(batch.column("class").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if ids and (c != name or len(ids) == PIECE):
                    yield pa.RecordBatch.from_pydict({"class": [name], "first": [first], "text": [",".join(ids)]})
                    ids = []
                if not ids:
                    name, first = c, conv
                ids.append(str(conv))
        if ids:
            yield pa.RecordBatch.from_pydict({"class": [name], "first": [first], "text": [",".join(ids)]})

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for c, text in zip(batch.column("class").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if state is not None and c == name:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = c, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_pydict({"class": pa.array([d[0] for d in done], pa.int64()), "ends": pa.array([d[1] for d in done], pa.string())})
        if state is not None:
            yield pa.RecordBatch.from_pydict({"class": [name], "ends": [state.hexdigest()]})

    order = ["class", "conv"]
    cut = classes.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "class long, first long, text string")
    return cut.repartition("class").sortWithinPartitions("class", "first").mapInArrow(hashes, "class long, ends string")


def prefix_trie(turns: DataFrame, scratch: Scratch, family: int = 20, most_shared: int = 4, *, run: int = RUN, block: int = BLOCK, fill: int = FILL) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    built, lengths = rebuild(turns, scratch, family, most_shared)
    classes = scratch.table(_classes(built, lengths), "classes")
    line = scratch.table(sorted_classes(built, classes, scratch, run), "line")
    rows = line.count()
    scratch.drop("own", "runs", "names-sorted", "names", "classes-sorted", "ranked")

    blocks = line.withColumn("block", F.floor(F.col("i") / block)).groupBy("block")
    local = scratch.table(blocks.applyInArrow(_inside_block, SMALLER), "local")
    chains = scratch.table(blocks.applyInArrow(_chains, CHAIN), "chains")
    smaller = scratch.table(_across_blocks(local.select("i", "lcp", "left", "right", "low"), chains, rows, block), "smaller")

    # branchings: one node for all equal values of an interval; leaves: classes that no other continues
    following = line.select((F.col("i") - 1).alias("i"), F.col("lcp").alias("next"))
    places = line.join(following, "i", "left").na.fill(-1, ["next"]).withColumn("leaf", (F.col("length") > F.col("next")).cast("int"))
    places = scratch.table(_running(places, block, convs=F.col("n"), leaves=F.col("leaf")), "places")
    branchings = smaller.where("lcp >= 0").groupBy("left", (F.col("right") - 1).alias("last"), "lcp").agg(F.min("low").alias("low"))
    leaves = places.where("leaf = 1").select(F.col("i").alias("left"), F.col("i").alias("last"), F.col("length").alias("lcp"), F.col("class").alias("low"))
    nodes = _block_minimum(branchings, local, rows, block).unionByName(leaves)

    # what is above: the deeper of the values on either side of the interval, whose own interval begins there or where that value's does
    before = places.join(smaller.select("i", F.col("left").alias("outer")), "i").select(
        F.col("i").alias("left"), F.col("class").alias("first_class"), F.col("length").alias("first_length"), F.col("lcp").alias("left_lcp"), "outer",
        (F.col("convs") - F.col("n")).alias("convs_before"), (F.col("leaves") - F.col("leaf")).alias("leaves_before"),
    )
    after = places.select(F.col("i").alias("last"), "next", "convs", "leaves")
    above = F.greatest("left_lcp", "next")
    nodes = nodes.join(before, "left").join(after, "last").select(
        "left", "last", "lcp", "low", "first_class", "first_length",
        (F.col("convs") - F.col("convs_before")).alias("n_convs"), (F.col("leaves") - F.col("leaves_before")).alias("n_leaves"),
        above.alias("above"), F.when(F.col("left_lcp") >= F.col("next"), F.coalesce("outer", "left")).otherwise(F.col("left")).alias("above_left"),
    )

    # words of the edge down to a node, as differences of running sums along its first class
    for depth, sum_ in (("lcp", "words_to"), ("above", "words_above")):
        nodes = nodes.join(built.select(F.col("conv").alias("first_class"), F.col("pos").alias(depth), F.col("run_words").alias(sum_)), ["first_class", depth], "left")
    nodes = scratch.table(nodes.na.fill(0, ["words_to", "words_above"]).withColumn("edge_saved", (F.col("n_convs") - 1) * (F.col("words_to") - F.col("words_above"))), "nodes")

    # savings below a node: nodes are in preorder by (left, lcp), and a subtree ends where its interval does
    by_left = line.select("i").join(nodes.groupBy(F.col("left").alias("i")).agg(F.sum("edge_saved").alias("saved")), "i", "left").na.fill(0)
    sums = scratch.table(_running(by_left, block, upto=F.col("saved")), "sums")
    along = Window.partitionBy("left").orderBy("lcp").rowsBetween(Window.unboundedPreceding, 0)
    at_left = sums.select(F.col("i").alias("left"), (F.col("upto") - F.col("saved")).alias("earlier"))
    at_last = sums.select(F.col("i").alias("last"), "upto")
    nodes = nodes.withColumn("so_far", F.sum("edge_saved").over(along)).join(at_left, "left").join(at_last, "last")
    nodes = nodes.withColumn("below", F.col("upto") - F.col("earlier") - F.col("so_far"))

    children = nodes.groupBy(F.col("above_left").alias("left"), F.col("above").alias("lcp")).agg(F.count("*").alias("n_below"))
    parents = nodes.select(F.col("left").alias("above_left"), F.col("lcp").alias("above"), F.col("low").alias("above_low"))
    nodes = nodes.join(children, ["left", "lcp"], "left").join(parents, ["above_left", "above"], "left")
    nodes = nodes.join(_member_hashes(classes).withColumnRenamed("class", "first_class"), "first_class")
    nodes = nodes.withColumn("ends", F.when(F.col("first_length") == F.col("lcp"), F.col("ends")))

    # missing depths: every depth between the node above and this one, in two steps so that no array is long
    start = F.col("above") + 1
    steps = nodes.withColumn("from", F.explode(F.sequence(start, F.greatest(F.col("lcp"), start), F.lit(fill).cast("long"))))
    depths = steps.withColumn("depth", F.explode(F.sequence(F.col("from"), F.least(F.col("lcp"), F.col("from") + (fill - 1)))))
    own = built.select(F.col("conv").alias("first_class"), F.col("pos").alias("depth"), "words", "run_words")
    deepest, topmost = F.col("depth") == F.col("lcp"), F.col("depth") == start
    sum_above = F.coalesce(F.col("run_words") - F.col("words"), F.lit(0))
    return depths.join(own, ["first_class", "depth"], "left").select(
        F.col("low").alias("conv_id"),
        "depth",
        F.when(topmost, F.col("above_low")).otherwise(F.col("low")).alias("parent_conv_id"),
        "n_convs",
        F.when(deepest, F.coalesce("n_below", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long"),
        (F.col("below") + (F.col("n_convs") - 1) * (F.col("words_to") - sum_above)).alias("saved_tokens"),
        F.when(deepest, F.coalesce("ends", F.lit(NO_MEMBERS))).otherwise(NO_MEMBERS).alias("ends_sha256"),
    )
