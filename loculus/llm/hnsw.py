"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of bounded size by chance, whatever their ids; shards
grow with the table up to ``MOST_SHARD_ROWS``.  A shard's distinct vectors (copies
share a node, with their ids beside it) get random levels and are inserted in
batches: a batch descends the graph so far in lock step, with a beam on every
level, and every node is linked to diverse ones among those it met and the others
of its batch (a candidate is skipped if it is nearer to a chosen neighbour than to
the node).  Links go both ways; a node with too many keeps diverse ones.  So a
shard is built in about its size times the logarithm of it.  Links are kept as
one flat array of fixed width per level.

A search descends the levels with a beam and works on a block of queries in
lock step.  The index is an ordinary table with one row per shard.  A task loads
one shard and reads the stored queries past it block by block, so neither index
rows nor queries are shuffled for it; each shard gives its nearest by exact
double-precision distance, and Spark merges them, cutting to the nearest before
its shuffle.

Edge cases: vectors that are null, empty, zero, of another length than most, or
hold null or non-finite components take no part, and neither do rows without an
id; rows that share the query's id are the query's own; rows that share an id but
not a vector are candidates each, and as queries share one ranking; ties go to
smaller ids; with fewer candidates than asked for all are returned; an empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.llm.common import Scratch
from loculus.llm.files import resolve, tidy

#: Vectors of a shard on average: at least, at most, and between them so many that there are about so many shards.
SHARD_ROWS, MOST_SHARD_ROWS, SHARDS = 4096, 1 << 14, 64
#: Links of a node (twice as many on the ground level).
LINKS = 16
#: Nodes inserted together, at most as many as there are already; and width of their beam.
BATCH, FIRST_BATCH = 1024, 64
BUILD_BEAM = 40
#: Width of a search's beam on the ground (of a shard of ``SHARD_ROWS``; it grows with the root of the rows) and above.
BEAM = 96
UPPER_BEAM = 12
#: Queries that are searched together.
QUERY_BLOCK = 1024

INDEX_SCHEMA = "shard int, dimension int, vectors array<{kind}>, ids array<long>, id_starts array<int>, levels array<struct<nodes:array<int>,links:array<int>,width:int>>"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_rows(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of rows that take part."""
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (usual["n"] if usual else 0))


def _diverse(points: np.ndarray, owners: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
    """Of each owner's near ones (nearest first, -1 fills up) up to ``width`` that are nearer to it than to those chosen before.

    Free places go to the nearest of those that were passed over: where one vector lies between all others, as an
    average does, hardly any would be left else.
    """
    out = np.full((len(owners), width), -1, np.int32)
    for at in range(0, len(owners), 256):
        block, ids = points[owners[at : at + 256]], near[at : at + 256]
        cloud = points[np.maximum(ids, 0)]  # (rows, candidates, dimension)
        own = ((cloud - block[:, None, :]) ** 2).sum(axis=2)
        squares = (cloud * cloud).sum(axis=2)
        between = squares[:, :, None] + squares[:, None, :] - 2 * cloud @ cloud.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            crowded = (chosen & (between[:, c, :] < own[:, c, None])).any(axis=1)
            chosen[:, c] = ~crowded & (chosen.sum(axis=1) < width) & (ids[:, c] >= 0)
        over = ~chosen & (ids >= 0)
        chosen |= over & (np.cumsum(over, axis=1) <= width - chosen.sum(axis=1, keepdims=True))
        rows, places = np.nonzero(chosen)
        rank = (np.cumsum(chosen, axis=1) - 1)[rows, places]
        out[at + rows, rank] = ids[rows, places]
    return out


def _by_distance(points: np.ndarray, squares: np.ndarray, owners: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest of each owner's ids (-1 fills up), nearest first, itself and repeats left out."""
    ids = np.sort(np.where(ids == owners[:, None], -1, ids), axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    distance = squares[np.maximum(ids, 0)] - 2 * np.einsum("qnd,qd->qn", points[np.maximum(ids, 0)], points[owners], optimize=True)
    order = np.argsort(np.where(ids >= 0, distance, np.inf), axis=1, kind="stable")[:, :count]
    return np.take_along_axis(ids, order, 1)


class _Level:
    """Links of one level while it is built: a row of ``width`` node numbers per node, -1 fills up."""

    def __init__(self, nodes: int, links: int, width: int) -> None:
        self.links, self.width, self.flat = links, width, np.full((nodes, width), -1, np.int32)

    def join(self, points: np.ndarray, squares: np.ndarray, nodes: np.ndarray, met: np.ndarray) -> None:
        """Link new ``nodes`` to diverse ones of those that each has met, and those back to them."""
        near = _by_distance(points, squares, nodes, met, BUILD_BEAM)
        chosen = _diverse(points, nodes, near, self.links)
        self.flat[nodes, : self.links] = chosen
        row, place = np.nonzero(chosen >= 0)
        source, target = nodes[row].astype(np.int32), chosen[row, place]
        known = (self.flat[target] == source[:, None]).any(axis=1)
        source, target = source[~known], target[~known]
        distance = squares[source] - 2 * np.einsum("nd,nd->n", points[source], points[target], optimize=True)
        order = np.lexsort((distance, target))
        source, target = source[order], target[order]
        # a popular target takes the nearest offers only, as many as it has places
        inside = np.arange(len(target)) - np.searchsorted(target, target) < self.width
        source, target = source[inside], target[inside]
        owners, first, counts = np.unique(target, return_index=True, return_counts=True)
        if not len(owners):
            return
        offers = np.full((len(owners), counts.max()), -1, np.int32)
        offers[np.repeat(np.arange(len(owners)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        every = np.concatenate([self.flat[owners], offers], axis=1)
        full = (every >= 0).sum(axis=1) > self.width
        packed = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable")[:, : self.width], 1)
        self.flat[owners[~full]] = packed[~full]
        if full.any():
            crowd = owners[full]
            self.flat[crowd] = _diverse(points, crowd, _by_distance(points, squares, crowd, every[full], every.shape[1]), self.width)


def insert_points(points: np.ndarray, level: np.ndarray) -> list[_Level]:
    """Levels from the ground up, built by inserting ``points`` in batches; ``level`` is each one's highest."""
    squares = (points * points).sum(axis=1)
    top = int(level.max())
    levels = [_Level(len(points), LINKS if d == 0 else LINKS // 2, 2 * LINKS if d == 0 else LINKS) for d in range(top + 1)]
    order = np.lexsort((np.random.default_rng(7).random(len(points)), -level))[:FIRST_BATCH]  # the highest come first, so every level has an entry
    rest = np.setdiff1d(np.arange(len(points)), order)
    rest = np.random.default_rng(8).permutation(rest)
    there, batch = np.empty(0, np.int64), order
    while len(batch):
        beside = squares[batch][None, :] - 2 * points[batch] @ points[batch].T
        beside[np.arange(len(batch)), np.arange(len(batch))] = np.inf
        found = None
        if len(there):
            entry = there[level[there] >= top][:UPPER_BEAM]
            found = np.broadcast_to(entry.astype(np.int32), (len(batch), len(entry)))
        for d in range(top, -1, -1):
            if found is not None:
                found = _beam_search(points, squares, levels[d].flat, points[batch], found, BUILD_BEAM if d == 0 else 2 * UPPER_BEAM)
            mine = np.flatnonzero(level[batch] >= d)
            if len(mine):
                other = beside[np.ix_(mine, mine)]
                most = min(LINKS, len(mine) - 1)
                near = batch[mine][np.argpartition(other, most - 1, axis=1)[:, :most]] if most else np.empty((len(mine), 0), np.int64)
                met = near if found is None else np.concatenate([found[mine], near], axis=1)
                if met.shape[1]:
                    levels[d].join(points, squares, batch[mine], met.astype(np.int64))
        there = np.concatenate([there, batch])
        size = min(BATCH, len(there))
        batch, rest = rest[:size], rest[size:]
    return levels


def build_graph(ids: np.ndarray, vectors: np.ndarray, copies: int) -> dict:
    """A shard's index row: distinct vectors, the ``copies`` smallest ids of each, and its levels from the ground up."""
    points, node = np.unique(vectors, axis=0, return_inverse=True)
    node = node.reshape(-1)
    order = np.lexsort((ids, node))
    ids, node = ids[order], node[order]
    starts = np.searchsorted(node, np.arange(len(points)))
    keep = np.arange(len(ids)) - starts[node] < copies
    ids, node = ids[keep], node[keep]
    starts = np.searchsorted(node, np.arange(len(points) + 1))
    level = np.minimum((-np.log(np.random.default_rng(len(points)).random(len(points))) / np.log(LINKS)).astype(int), 6)
    levels = []
    for depth, built in enumerate(insert_points(points.astype(np.float32, copy=False), level)):
        nodes = np.flatnonzero(level >= depth)
        levels.append({"nodes": nodes.astype(np.int32), "links": built.flat[nodes].reshape(-1), "width": built.width})
    return {"dimension": points.shape[1], "vectors": points.reshape(-1), "ids": ids, "id_starts": starts.astype(np.int32), "levels": levels}


def _beam_search(points: np.ndarray, squares: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> np.ndarray:
    """Nodes of the nearest found for each query (-1 fills up), nearest first, from entry nodes; ``links`` has a row per node."""
    rows = np.arange(len(queries))
    seen = np.zeros((len(queries), len(points) + 1), bool)  # the last column stands for -1
    seen[:, -1] = True

    def measure(q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        nodes = np.where(nodes >= 0, nodes, len(points))
        fresh = ~seen[q[:, None], nodes]
        seen[q[:, None], nodes] = True
        safe = np.minimum(nodes, len(points) - 1)
        distance = squares[safe] - 2 * np.einsum("qnd,qd->qn", points[safe], queries[q], optimize=True)
        return np.where(fresh, distance, np.inf)

    nodes = np.full((len(queries), beam), -1, np.int32)
    distance, done = np.full((len(queries), beam), np.inf, np.float32), np.zeros((len(queries), beam), bool)
    new_nodes, new_distance, active = entries, measure(rows, entries), rows
    while len(active):
        all_nodes = np.concatenate([nodes[active], new_nodes], axis=1)
        all_distance = np.concatenate([distance[active], new_distance], axis=1)
        all_done = np.concatenate([done[active], np.zeros(new_nodes.shape, bool)], axis=1)
        best = np.argsort(all_distance, axis=1, kind="stable")[:, :beam]
        nodes[active], distance[active], done[active] = (np.take_along_axis(x, best, 1) for x in (all_nodes, all_distance, all_done))
        waiting = np.where(done[active], np.inf, distance[active])
        pick = waiting.argmin(axis=1)
        active, pick = active[(more := waiting[np.arange(len(active)), pick] < np.inf)], pick[more]
        done[active, pick] = True
        new_nodes = links[nodes[active, pick]]
        new_distance = measure(active, new_nodes) if len(active) else new_distance[:0]
    return np.where(distance < np.inf, nodes, -1)


def search_graph(index: dict, query_ids: np.ndarray, given: np.ndarray, k: int, beam: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, distance) of each query's ``k`` nearest found in a shard; distances in double precision, of vectors as given."""
    original = index["vectors"].reshape(-1, index["dimension"])
    points, queries = original.astype(np.float32, copy=False), given.astype(np.float32, copy=False)
    beam = beam or int(BEAM * max(1.0, (len(points) / SHARD_ROWS) ** 0.5))
    squares = (points * points).sum(axis=1)
    top = index["levels"][-1]["nodes"]
    found = np.argsort(squares[top][None, :] - 2 * queries @ points[top].T, axis=1, kind="stable")[:, :UPPER_BEAM]
    found = top[found]
    for depth in range(len(index["levels"]) - 1, -1, -1):
        level = index["levels"][depth]
        links = np.full((len(points), level["width"]), -1, np.int32)
        links[level["nodes"]] = level["links"].reshape(-1, level["width"])
        found = _beam_search(points, squares, links, queries, found, max(beam, k) if depth == 0 else UPPER_BEAM)
    row, place = np.nonzero(found >= 0)
    node = found[row, place]
    exact = np.sqrt(((original[node].astype(np.float64) - given[row].astype(np.float64)) ** 2).sum(axis=1))
    copies = np.diff(index["id_starts"])[node]
    at = np.repeat(index["id_starts"][node] - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())
    ids, owner, exact = index["ids"][at], np.repeat(row, copies), np.repeat(exact, copies)
    other = ids != query_ids[owner]
    ids, owner, exact = ids[other], owner[other], exact[other]
    order = np.lexsort((ids, exact, owner))
    ids, owner, exact = ids[order], owner[order], exact[order]
    near = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
    return query_ids[owner[near]], ids[near], exact[near]


def build_index(vectors: DataFrame, copies: int) -> DataFrame:
    """One row per shard of ``vectors`` (vec_id, embedding, shard); a vector keeps its ``copies`` smallest ids in each."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        lists = rows.column("embedding").combine_chunks()
        points = lists.values.to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), -1)
        graph = build_graph(rows.column("vec_id").to_numpy(), points, copies)
        return pa.Table.from_pylist([{"shard": key[0].as_py()} | graph], schema=schema)

    exact = vectors.schema["embedding"].dataType.elementType.typeName() == "double"
    kind = np.float64 if exact else np.float32
    level = pa.struct([("nodes", pa.list_(pa.int32())), ("links", pa.list_(pa.int32())), ("width", pa.int32())])
    schema = pa.schema(
        [
            ("shard", pa.int32()),
            ("dimension", pa.int32()),
            ("vectors", pa.list_(pa.float64() if exact else pa.float32())),
            ("ids", pa.list_(pa.int64())),
            ("id_starts", pa.list_(pa.int32())),
            ("levels", pa.list_(level)),
        ]
    )
    return vectors.groupBy("shard").applyInArrow(build, INDEX_SCHEMA.format(kind="double" if exact else "float"))


def _loaded(batch: pa.RecordBatch, row: int) -> dict:
    """A shard's index row as numpy arrays."""
    flat = lambda c: batch.column(c).slice(row, 1).flatten().to_numpy(zero_copy_only=False)
    levels = batch.column("levels").slice(row, 1).flatten()
    nodes, links, width = (levels.field(k) for k in ("nodes", "links", "width"))
    found = [{"nodes": nodes[d].values.to_numpy(), "links": links[d].values.to_numpy(), "width": width[d].as_py()} for d in range(len(levels))]
    return {"dimension": batch.column("dimension")[row].as_py(), "vectors": flat("vectors"), "ids": flat("ids"), "id_starts": flat("id_starts"), "levels": found}


def _stored_queries(folder: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries stored in a folder, block by block."""
    store, base = resolve(folder)
    for file in sorted(f.path for f in store.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet")):
        with store.open_input_file(file) as source:
            for block in pa.parquet.ParquetFile(source).iter_batches(QUERY_BLOCK):
                lists = block.column("embedding")
                yield block.column("vec_id").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def nearest(vectors: DataFrame, scratch: Scratch, is_query: Column, k: int = 10, shard_rows: int | None = None, beam: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found for every row for which ``is_query`` holds."""
    chance = F.xxhash64(F.monotonically_increasing_id()).alias("chance")
    rows = scratch.table(usable_rows(vectors).select("vec_id", "embedding", chance), "vectors")
    count = rows.count()
    shard_rows = shard_rows or min(MOST_SHARD_ROWS, max(SHARD_ROWS, count // SHARDS))
    shards = max(1, -(-count // shard_rows))
    dealt = rows.select("vec_id", "embedding", F.pmod("chance", F.lit(shards)).cast("int").alias("shard"))
    index = scratch.table(build_index(dealt, k + 1), "index")
    scratch.table(rows.where(is_query).select("vec_id", "embedding").dropDuplicates(["vec_id", "embedding"]), "queries")
    folder = f"{scratch.path}/queries"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                graph = _loaded(batch, row)
                for query_ids, queries in _stored_queries(folder):
                    found = search_graph(graph, query_ids, queries, k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])
        tidy()

    near = index.repartitionById(shards, F.col("shard")).mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
