"""Alignment of versions by citation: floor, prefix-first floor, nearest, range and gated sibling joins.

Every join has an equality key (the version or work that is aligned).  Keys of
both sides are laid into one order per version, and running values (the last
chunk seen, the next one, how many there were) stand for a comparison of all
pairs, so work grows with the two sides and the result and not with their product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.functions.citekey import begins_with, distance


def floor_join(probes: DataFrame, chunks: DataFrame, by: Sequence[str], probe_key: str, chunk_key: str, chunk: Column, pos: str) -> DataFrame:
    """``probes`` with ``floor``: the chunk with the greatest key at or before the probe's, the first of equal ones; else null.

    Both sides are laid into one order per ``by`` and the last chunk seen is
    carried on, which is linear after the sort.
    """
    first = chunks.groupBy(*by, chunk_key).agg(F.min_by(chunk, F.col(pos)).alias("_chunk"))
    left = probes.select(
        *[F.col(b) for b in by],
        F.col(probe_key).alias("_key"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(first.schema["_chunk"].dataType).alias("_chunk"),
        F.struct(*probes.columns).alias("_probe"),
    )
    right = first.select(
        *[F.col(b) for b in by],
        F.col(chunk_key).alias("_key"),
        F.lit(0).alias("_side"),
        "_chunk",
        F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"),
    )
    order = Window.partitionBy(*by).orderBy("_key", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = left.unionByName(right).withColumn("floor", F.last("_chunk", ignorenulls=True).over(order))
    return carried.where("_side = 1").select("_probe.*", "floor")


def _neighbours(targets: DataFrame, values: DataFrame, by: Sequence[str], target: str, value: str, carried: str) -> DataFrame:
    """``targets`` with ``below`` and ``above``: ``carried`` of the last value up to the target and of the first from it on (null without one); values are distinct per ``by``."""
    struct = F.struct(*[F.col(c) for c in targets.columns])
    left = targets.select(
        *by,
        F.col(target).alias("_key"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(values.schema[carried].dataType).alias("_c"),
        struct.alias("_t"),
    )
    right = values.select(
        *by,
        F.col(value).alias("_key"),
        F.lit(0).alias("_side"),
        F.col(carried).alias("_c"),
        F.lit(None).cast(left.schema["_t"].dataType).alias("_t"),
    )
    run = lambda *order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumns(
        {
            "below": F.last("_c", ignorenulls=True).over(run("_key", "_side")),
            "above": F.last("_c", ignorenulls=True).over(run(F.desc("_key"), "_side")),
        }
    )
    return both.where("_side = 1").select("_t.*", "below", "above")


def _component(key: Column, k: int) -> Column:
    return F.coalesce(F.get(key, F.lit(k)), F.lit(0).cast("long"))


def nearest_join(
    probes: DataFrame,
    chunks: DataFrame,
    by: Sequence[str],
    probe_key: str,
    chunk_key: str,
    chunk: Column,
    pos: str,
    depth: int = 3,
) -> DataFrame:
    """``probes`` with ``nearest``: the chunk whose key differs least, the earlier of equal ones; null where there are no chunks.

    Components are settled one after the other: the next value below and above
    the probe's, whichever is nearer (or both), and then the same among the
    chunks below it.  Chunks that agree in ``depth`` components are compared.
    """
    parts = [f"_c{k}" for k in range(depth)]
    right = chunks.select(
        *by,
        F.col(chunk_key).alias("_start"),
        chunk.alias("_chunk"),
        F.col(pos).alias("_pos"),
        *[_component(F.col(chunk_key), k).alias(c) for k, c in enumerate(parts)],
    )
    states = probes.select(*by, F.col(probe_key).alias("_key")).distinct()
    for k, c in enumerate(parts):
        known = [*by, *parts[:k]]
        wanted = states.withColumn("_w", _component(F.col("_key"), k))
        near = _neighbours(wanted, right.select(*known, c).distinct(), known, "_w", c, c)
        below, above = F.abs(F.col("_w") - F.col("below")), F.abs(F.col("_w") - F.col("above"))
        least = F.least(below, above)  # skips nulls
        chosen = F.array_distinct(
            F.filter(F.array(F.when(below == least, F.col("below")), F.when(above == least, F.col("above"))), lambda x: x.isNotNull())
        )
        states = near.select(*known, "_key", "_w", least.alias("_d"), F.explode(chosen).alias(c))
        # of several states of a probe only those stay that are as near so far
        states = states.withColumn("_d", F.min("_d").over(Window.partitionBy(*by, "_key")) == F.col("_d")).where("_d").drop("_w", "_d")
    best = F.min_by("_chunk", F.struct(distance(F.col("_key"), F.col("_start")), F.col("_pos")))
    found = states.join(right, [*by, *parts]).groupBy(*by, "_key").agg(best.alias("nearest"))
    return probes.withColumn("_key", F.col(probe_key)).join(found, [*by, "_key"], "left").select(*probes.columns, "nearest")


def prefix_floor_join(probes: DataFrame, chunks: DataFrame, by: Sequence[str], probe_key: str, chunk_key: str, chunk: Column, pos: str) -> DataFrame:
    """``probes`` with ``landing``: the lowest chunk below the probe's place, else the floor, else the first chunk.

    If any chunk lies below the place, the next one from the place on does.
    """
    first = F.min_by(chunk, F.col(pos)).alias("_chunk")
    values = chunks.groupBy(*by, chunk_key).agg(first).select(
        *by,
        F.col(chunk_key).alias("_start"),
        F.struct(F.col(chunk_key).alias("start"), "_chunk").alias("_at"),
    )
    starts = chunks.groupBy(*by).agg(first.alias("_first"))
    near = _neighbours(probes, values, by, probe_key, "_start", "_at").join(starts, list(by), "left")
    below = F.when(begins_with(F.col("above.start"), F.col(probe_key)), F.col("above._chunk"))
    return near.select(*probes.columns, F.coalesce(below, F.col("below._chunk"), F.col("_first")).alias("landing"))


def range_join(bases: DataFrame, chunks: DataFrame, by: Sequence[str], low: str, high: str, chunk_key: str) -> DataFrame:
    """Every chunk that starts inside a base's range, on equal ``by``; a base that is a single place also holds what lies below it.

    Chunks are numbered in order.  A running count tells how many start before
    a range and up to its end, so a base meets exactly the numbers between.
    """
    numbered = chunks.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(chunk_key)))
    ranges = bases.select(*by, F.col(low).alias("_low"), F.col(high).alias("_high")).distinct()
    last = F.size("_low")
    behind = F.concat(F.slice("_low", F.lit(1), last - 1), F.array(F.element_at("_low", -1) + 1))  # the first key behind what lies below a place
    point = F.col("_low") == F.col("_high")
    ends = F.array(
        F.struct(F.col("_low").alias("key"), F.lit(-1).alias("side"), F.lit(0).alias("end")),
        F.struct(F.when(point, behind).otherwise(F.col("_high")).alias("key"), F.when(point, -1).otherwise(1).alias("side"), F.lit(1).alias("end")),
    )
    asked = ranges.withColumn("e", F.explode(ends)).select(
        *by,
        F.col("e.key").alias("_key"),
        F.col("e.side").alias("_side"),
        F.struct("_low", "_high", "e.end").alias("_r"),
    )
    there = chunks.select(*by, F.col(chunk_key).alias("_key"), F.lit(0).alias("_side"), F.lit(None).cast(asked.schema["_r"].dataType).alias("_r"))
    running = F.count_if(F.col("_side") == 0).over(Window.partitionBy(*by).orderBy("_key", "_side").rowsBetween(Window.unboundedPreceding, 0))
    counted = asked.unionByName(there).withColumn("_count", running).where("_side <> 0").select(*by, "_r.*", "_count")
    spans = counted.groupBy(*by, "_low", "_high").agg(F.min("_count").alias("_from"), F.max("_count").alias("_to")).where("_to > _from")
    met = spans.withColumn("_n", F.explode(F.sequence((F.col("_from") + 1).cast("int"), F.col("_to").cast("int")))).drop("_from", "_to")
    held = met.join(numbered, [*by, "_n"]).drop("_n")
    return bases.withColumns({"_low": F.col(low), "_high": F.col(high)}).join(held, [*by, "_low", "_high"]).drop("_low", "_high")


def covered(bases: DataFrame, chunks: DataFrame, by: Sequence[str], low: str, chunk_key: str) -> DataFrame:
    """Bases that don't lie before the first or behind the last start of the chunks; keys compare as they are, whatever their depth."""
    ends = chunks.groupBy(*by).agg(F.min(chunk_key).alias("_min"), F.max(chunk_key).alias("_max"))
    return bases.join(ends, list(by)).where(F.col(low).between(F.col("_min"), F.col("_max"))).drop("_min", "_max")


def align_siblings(
    bases: DataFrame,
    chunks: DataFrame,
    by: Sequence[str],
    low: str,
    high: str,
    chunk_key: str,
    chunk: str,
    pos: str,
    files: DataFrame | None = None,
) -> DataFrame:
    """Rows of ``bases`` with an aligned ``chunk``: all in range, else the nearest one; bases outside the coverage drop out.

    With ``files`` (by, chunk) only chunks that are there count; a base whose
    aligned chunks are all missing gets its sibling's first page that exists.
    """
    inside = covered(bases, chunks, by, low, chunk_key)
    ranged = range_join(inside, chunks.select(*by, chunk_key, F.col(chunk).alias("aligned"), F.col(pos).alias("_pos")), by, low, high, chunk_key)
    ranged = ranged.select(*bases.columns, "aligned", F.lit("range").alias("how"))
    rest = inside.join(ranged.select(*bases.columns).distinct(), bases.columns, "left_anti")
    near = nearest_join(rest, chunks, by, low, chunk_key, F.col(chunk), pos)
    aligned = ranged.unionByName(near.select(*bases.columns, F.col("nearest").alias("aligned"), F.lit("nearest").alias("how")))
    if files is None:
        return aligned
    there = files.select(*by, F.col(chunk).alias("aligned")).distinct()
    kept = aligned.join(there, [*by, "aligned"], "left_semi").select(*aligned.columns)
    first = chunks.join(files.select(*by, chunk).distinct(), [*by, chunk], "left_semi").groupBy(*by).agg(F.min_by(chunk, pos).alias("aligned"))
    lost = inside.join(kept.select(*bases.columns).distinct(), bases.columns, "left_anti").join(first, list(by))
    return kept.unionByName(lost.select(*bases.columns, "aligned", F.lit("first").alias("how")))


def in_scheme(bases: DataFrame, schemes: DataFrame, by: Sequence[str], scheme: str) -> DataFrame:
    """``bases`` with ``used``: the sibling's scheme of the same name, else its default (""); bases of siblings with neither drop out."""
    offered = schemes.select(*by, F.col("scheme").alias("_offered")).distinct()
    same = bases.join(
        offered.withColumn("_same", F.lit(True)),
        [*[bases[b] == offered[b] for b in by], bases[scheme] == F.col("_offered")],
        "left",
    ).select(*[bases[c] for c in bases.columns], F.col("_offered").alias("_s"))
    default = offered.where("_offered = ''").select(*by, F.lit("").alias("_d"))
    return same.join(default, list(by), "left").withColumn("used", F.coalesce("_s", "_d")).where("used is not null").select(*bases.columns, "used")
