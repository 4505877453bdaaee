"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b: longs).

    Large-star and small-star steps in turn (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014): every node points its larger
    neighbours, then itself and its smaller ones, at the smallest node next to
    it, until nothing changes.  That takes a number of rounds logarithmic in
    the nodes in practice.  Smallest neighbours are found by aggregation, never
    by gathering a node's neighbours; each round's edges are written to the
    shared folder, and only their count and a checksum come to the driver.
    """
    current = scratch.table(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges-0")
    seen, round_ = None, 0
    while True:
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if state == seen or state[0] == 0:
            break
        seen, round_ = state, round_ + 1
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(current.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(nearest, "u").where("v > u").select("v", "m").distinct()
        nearest = large.groupBy("v").agg(F.min("m").alias("mm"))
        small = large.join(nearest, "v").select(
            F.explode(F.array(F.struct(F.col("m").alias("hi"), F.col("mm").alias("lo")), F.struct(F.col("v").alias("hi"), F.col("mm").alias("lo")))).alias("e")
        ).select("e.*")
        current = scratch.table(small.where("hi <> lo").distinct().select("lo", "hi"), f"edges-{round_}")
        scratch.drop(f"edges-{round_ - 1}")
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
