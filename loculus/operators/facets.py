"""Facets over bitmaps: which rows have a value is a set of bits, and counts under choices are ands and ors of such sets.

Rows are numbered once.  Of every value of every facet the index keeps the
numbers of its rows as bitmaps of 32,768 bits; choices within a facet are or-ed,
facets are and-ed, and a value's count is the bits that are left, so no row is
looked at again and none is repeated for each facet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loculus.operators.ranking import global_places
from loculus.session import stored

BITMAP = ["facet", "value", "bucket", "bits"]


@dataclass(frozen=True)
class FacetIndex:
    """rows (number from 0, and the columns given), bitmaps (facet, value, bucket, bits), and the facets' names."""

    rows: DataFrame
    bitmaps: DataFrame
    facets: tuple[str, ...]


def _bits(rows: DataFrame, facet: str, value: Column) -> DataFrame:
    at = F.col("number")
    grouped = rows.groupBy(value.alias("value"), F.bitmap_bucket_number(at).alias("bucket"))
    return grouped.agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).select(F.lit(facet).alias("facet"), "value", "bucket", "bits")


def facet_index(rows: DataFrame, key: str, facets: Sequence[str]) -> FacetIndex:
    """Index ``rows``, of which every key has one."""
    numbered = stored(global_places(rows, [F.col(key)], "number"))
    count, keys = numbered.agg(F.count("*"), F.count_distinct(key)).first()
    if count != keys:
        raise ValueError(f"{count} rows have {keys} different keys; facets are counted over rows with one key each")
    parts = [_bits(numbered, f, F.col(f).cast("string")) for f in facets]
    return FacetIndex(numbered, stored(reduce(DataFrame.unionByName, parts)), tuple(facets))


def _chosen(index: FacetIndex, chosen: Mapping[str, Sequence[str]], where: Column | None) -> DataFrame:
    """(by, bucket, bits): of every facet with a choice the rows that it leaves, and of the condition, if there is one."""
    picked = reduce(lambda a, b: a | b, [(F.col("facet") == f) & F.col("value").isin(*v) for f, v in chosen.items() if v], F.lit(False))
    sets = index.bitmaps.where(picked).groupBy(F.col("facet").alias("by"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    if where is None:
        return sets
    rest = _bits(index.rows.where(where), "", F.lit(None).cast("string"))
    return sets.unionByName(rest.select(F.col("facet").alias("by"), "bucket", "bits"))


def facet_counts(index: FacetIndex, chosen: Mapping[str, Sequence[str]], where: Column | None = None) -> DataFrame:
    """(facet, value, n): rows of each value of each facet under the choices made in the other facets, and a condition on rows."""
    by = [f for f, v in chosen.items() if v] + ([""] if where is not None else [])
    known = _chosen(index, chosen, where)
    own = index.bitmaps.select("facet", "value", "bucket", "bits", F.lit(1).alias("sets"))
    targets = index.bitmaps.select("facet", "value", "bucket")
    met = targets.join(known, "bucket").where(F.col("facet") != F.col("by")).select("facet", "value", "bucket", "bits", F.lit(1).alias("sets"))
    needed = 1 + sum((F.when(F.col("facet") != b, 1).otherwise(0) for b in by), F.lit(0))
    left = own.unionByName(met).groupBy("facet", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.sum("sets").alias("sets"))
    return left.groupBy("facet", "value").agg(F.coalesce(F.sum(F.when(F.col("sets") == needed, F.bitmap_count("bits"))), F.lit(0)).alias("n"))


def shown(index: FacetIndex, chosen: Mapping[str, Sequence[str]], where: Column | None = None) -> DataFrame:
    """(shown, total): how many rows all choices leave, of how many."""
    sets = sum(1 for v in chosen.values() if v) + (where is not None)
    total = index.rows.agg(F.count("*").alias("total"))
    if not sets:
        return total.select(F.col("total").alias("shown"), "total")
    left = _chosen(index, chosen, where).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("sets"))
    counted = left.agg(F.coalesce(F.sum(F.when(F.col("sets") == sets, F.bitmap_count("bits"))), F.lit(0)).alias("shown"))
    return counted.join(F.broadcast(total), how="inner", on=F.lit(True))  # one row each
