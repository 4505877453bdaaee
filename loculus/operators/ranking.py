"""Places in one order over a whole table, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.session import stored


def global_places(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: their place from 1 in the given order.

    Rows are sorted by ranges and stored with a number that holds the range and
    the place inside it; only the ranges' sizes, one row each, are summed up.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = kept.groupBy(part.alias("_range")).agg(F.count("*").alias("_n")).withColumn("_before", before).drop("_n")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = kept.withColumn("_range", part).join(F.broadcast(starts), "_range")  # one row per range
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + inside + 1).alias(name))
