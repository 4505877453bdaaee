"""Hard negatives by a two-dimensional block matrix multiplication.

Anchors are the rows of one matrix, all rows those of the other.  Both are cut
into blocks of rows and into chunks of dimensions.  Every (anchor block, row
block, chunk) is multiplied by itself; the partial score tiles (64-bit integers)
of a pair of blocks are added up behind a shuffle, as in the SUMMA scheme.  Of
each sum only what can still count is kept: an anchor's best positives in the
tile, and the negatives that reach the window of the worst of them.  Positives
are ranked over the tiles; then each tile gives the first negatives of every
(anchor, positive) window, and these are ranked over the tiles too.

Anchors go through in waves, so that the tiles of a wave have a bounded number
of cells however many rows there are.  No row is compared twice, and no block
meets a block that isn't asked for.

Edge cases: rows without an id, a label or a vector, or with a null or
non-finite component, take no part; an empty vector has score 0 with all; a
shorter vector counts as if zeros followed; scaled components are held to
``MOST_COMPONENT``, so that scores of up to 64 such dimensions stay exact in 64
bits; rows that share an id are rows of their own, and each is an anchor for
itself if its id is one; an anchor without positives, or a positive without
negatives in its window, gives no row; an empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.llm.common import Scratch
from loculus.llm.files import tidy

#: Rows of a block, anchors of a block, dimensions of a chunk at least, chunks at most, integers of a block at most.
BLOCK_ROWS, BLOCK_ANCHORS, CHUNK_DIMS, MOST_CHUNKS, BLOCK_INTS = 4096, 256, 32, 8, 1 << 24
#: Scores that the tiles of one wave hold.
WAVE_CELLS = 1 << 32
#: Components are multiplied by this and rounded down; the largest that is told apart.
SCALE, MOST_COMPONENT = 256, 1 << 27
#: Positives of an anchor, negatives of a window.
POSITIVES, NEGATIVES = 5, 5

BLOCK = "block int, chunk int, vectors binary, rows binary, ids binary, labels binary"
TILE = "a int, b int, scores binary, a_rows binary, a_ids binary, a_labels binary, b_rows binary, b_ids binary, b_labels binary"
FOUND = "a int, b int, positives array<struct<anchor_row long, anchor_id long, positive_id long, score long>>, rows binary, ends binary, ids binary, scores binary"
PICKED = "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


def _packer(width: int, chunk: int) -> Callable[[pa.Table], pa.Table]:
    """Rows of a block to one matrix for each chunk of dimensions; the first brings ids and labels."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("vec_id", "ascending"), ("row", "ascending")])
        parts = table.column("parts").combine_chunks()
        size, values = parts.value_lengths().to_numpy(zero_copy_only=False), parts.flatten().to_numpy(zero_copy_only=False)
        matrix = np.zeros((len(size), width), np.int32)
        line = np.repeat(np.arange(len(size)), size)
        matrix[line, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
        named = [table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("row", "vec_id", "label")]
        out = []
        for k, at in enumerate(range(0, width, chunk)):
            out.append((table.column("block")[0].as_py(), k, np.ascontiguousarray(matrix[:, at : at + chunk]).tobytes(), *(named if k == 0 else [None] * 3)))
        return pa.Table.from_pydict(
            dict(zip([c.split()[0] for c in BLOCK.split(", ")], zip(*out, strict=True), strict=True)),
            schema=pa.schema([("block", pa.int32()), ("chunk", pa.int32()), *((c, pa.binary()) for c in ("vectors", "rows", "ids", "labels"))]),
        )

    return pack


def _multiplier(width: int, chunk: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def multiply(one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows or not other.num_rows:  # a block that no row has fallen into
            return _arrow(TILE).empty_table()
        x, y = one.to_pylist()[0], other.to_pylist()[0]
        dims = min(chunk, width - x["chunk"] * chunk)
        left, right = (np.frombuffer(v["vectors"], np.int32).reshape(-1, dims) for v in (x, y))
        bound = int(np.abs(left.astype(np.int64)).max()) * int(np.abs(right.astype(np.int64)).max()) * dims
        kind = np.float64 if bound < 1 << 53 else np.int64  # exact either way
        tile = (left.astype(kind) @ right.astype(kind).T).astype(np.int64)
        row = {"a": x["block"], "b": y["block"], "scores": tile.tobytes()}
        row |= {f"{side}_{c}": v[c] for side, v in (("a", x), ("b", y)) for c in ("rows", "ids", "labels")}
        return pa.Table.from_pylist([row], schema=_arrow(TILE))

    return multiply


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _first(scores: np.ndarray, places: np.ndarray, most: int | None = None) -> np.ndarray:
    """Those of ``places`` with the highest scores, best first; earlier places win ties."""
    return places[np.argsort(-scores[places], kind="stable")][:most]


def _reduce(table: pa.Table) -> pa.Table:
    """Add the partial tiles of two blocks up; keep the best positives and the negatives that may lie in a window."""
    rows = table.to_pylist()
    meta = next(r for r in rows if r["a_ids"] is not None)
    a_rows, a_ids, a_labels, b_rows, b_ids, b_labels = (np.frombuffer(meta[c], np.int64) for c in ("a_rows", "a_ids", "a_labels", "b_rows", "b_ids", "b_labels"))
    total = np.zeros(len(a_rows) * len(b_rows), np.int64)
    for r in rows:
        total += np.frombuffer(r["scores"], np.int64)
    total = total.reshape(len(a_rows), len(b_rows))
    positives, kept, ends = [], [], []
    for k, scores in enumerate(total):
        alike = b_labels == a_labels[k]
        best = _first(scores, np.flatnonzero(alike & (b_rows != a_rows[k])), POSITIVES)
        positives += [{"anchor_row": a_rows[k], "anchor_id": a_ids[k], "positive_id": b_ids[p], "score": scores[p]} for p in best.tolist()]
        # the worst positive of all tiles is no worse than that of this one, and no window reaches below 0
        worst = int(scores[best[-1]]) if len(best) == POSITIVES else 0
        kept.append(_first(scores, np.flatnonzero(~alike & (5 * scores >= max(0, 4 * worst)))))
        ends.append(len(kept[-1]))
    line = np.repeat(np.arange(len(kept)), ends)
    columns = np.concatenate([*kept, np.empty(0, np.int64)]).astype(np.int64)
    out = {
        "a": [meta["a"]],
        "b": [meta["b"]],
        "positives": [positives],
        "rows": [a_rows.tobytes()],
        "ends": [np.cumsum(ends).astype(np.int64).tobytes()],
        "ids": [b_ids[columns].tobytes()],
        "scores": [total[line, columns].tobytes()],
    }
    struct = pa.struct([(c, pa.int64()) for c in ("anchor_row", "anchor_id", "positive_id", "score")])
    kinds = [("a", pa.int32()), ("b", pa.int32()), ("positives", pa.list_(struct)), *((c, pa.binary()) for c in ("rows", "ends", "ids", "scores"))]
    return pa.Table.from_pydict(out, schema=pa.schema(kinds))


def _pick(tile: pa.Table, windows: pa.Table) -> pa.Table:
    """The first negatives of a tile in each window of its anchors."""
    if not tile.num_rows or not windows.num_rows:
        return _arrow(PICKED).empty_table()
    found = tile.to_pylist()[0]
    line = {row: k for k, row in enumerate(np.frombuffer(found["rows"], np.int64).tolist())}
    ends, ids, scores = (np.frombuffer(found[c], np.int64) for c in ("ends", "ids", "scores"))
    out = []
    for w in windows.to_pylist():
        k, p = line[w["anchor_row"]], w["positive_score"]
        start, end = (int(ends[k - 1]) if k else 0), int(ends[k])
        falling = -scores[start:end]
        first = start + int(np.searchsorted(falling, -p, "left"))
        last = start + int(np.searchsorted(falling, -4 * p // 5, "right"))  # scores of 4p/5 and more
        for at in range(first, min(last, first + NEGATIVES)):
            out.append({**{c: w[c] for c in ("anchor_row", "anchor_id", "place", "positive_id", "positive_score")}, "negative_id": ids[at], "negative_score": scores[at]})
    tidy()
    return pa.Table.from_pylist(out, schema=_arrow(PICKED))


def hard_negatives(vectors: DataFrame, scratch: Scratch, anchors: Column, wave_cells: int = WAVE_CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, embedding, label).

    An anchor's positives are its best other rows with its label; a positive's negatives the best rows with another
    label whose score lies between 80 % of its own and its own.
    """
    spark = vectors.sparkSession
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-float(MOST_COMPONENT))), F.lit(float(MOST_COMPONENT)))).cast("int")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long"),
        F.col("label").cast("long"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.transform("embedding", whole).alias("parts"),
    )
    rows = scratch.table(rows, "rows")
    count, asked, width = rows.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("parts")), F.lit(0))).first()
    width = max(width, 1)
    chunk = max(CHUNK_DIMS, -(-width // MOST_CHUNKS))
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_INTS // width))
    row_blocks, anchor_blocks = max(1, -(-count // block_rows)), max(1, -(-asked // min(BLOCK_ANCHORS, block_rows)))
    a_wave = max(1, wave_cells // max(1, count * BLOCK_ANCHORS))  # anchor blocks of a wave
    pack, schema = _packer(width, chunk), BLOCK
    dealt = lambda frame, blocks: frame.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    right = scratch.table(dealt(rows, row_blocks).groupBy("block").applyInArrow(pack, schema), "right")
    left = scratch.table(dealt(rows.where("anchor"), anchor_blocks).groupBy("block").applyInArrow(pack, schema), "left")
    every = lambda first, end: F.explode(F.sequence(F.lit(first), F.lit(end - 1)))
    waves = []
    for wave, first in enumerate(range(0, anchor_blocks, a_wave)):
        end = min(first + a_wave, anchor_blocks)
        one = left.where(F.col("block").between(first, end - 1)).withColumns({"a": F.col("block"), "b": every(0, row_blocks)})
        other = right.withColumns({"a": every(first, end), "b": F.col("block")})
        partial = one.groupBy("a", "b", "chunk").cogroup(other.groupBy("a", "b", "chunk")).applyInArrow(_multiplier(width, chunk), TILE)
        tiles = scratch.table(partial.groupBy("a", "b").applyInArrow(_reduce, FOUND), f"tiles-{wave}")
        best = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "positive_id")
        positives = tiles.select("a", F.explode("positives").alias("p")).select("a", "p.*").withColumn("place", F.row_number().over(best)).where(F.col("place") <= POSITIVES)
        windows = positives.withColumnRenamed("score", "positive_score").withColumn("b", every(0, row_blocks))
        picked = tiles.drop("positives").groupBy("a", "b").cogroup(windows.groupBy("a", "b")).applyInArrow(_pick, PICKED)
        order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), "negative_id")
        ranked = picked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
        waves.append(scratch.table(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), f"found-{wave}"))
        scratch.drop(f"tiles-{wave}")
    scratch.drop("rows", "left", "right")
    return spark.read.schema(waves[0].schema).parquet(*(f"{scratch.path}/found-{k}" for k in range(len(waves))))

