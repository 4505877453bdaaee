"""Commentary on passages: overlap joins, grouping, and spans of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.functions.citekey import LYRIC_DIVISIONS, end_key, qualify, ranges_overlap, span, start_key, target_citation
from loculus.functions.urn import prefixes_meet

#: Halvings of the range of citation numbers (31 bits).
LEVELS = 31


def _leading(citation: Column) -> tuple[Column, Column]:
    """The lowest and the highest leading number of a citation."""
    one, two = start_key(citation)[0].cast("long"), end_key(citation)[0].cast("long")
    return F.least(one, two), F.greatest(one, two)


def _size(level: Column) -> Column:
    """How many numbers an interval of the level holds."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def dyadic_cover(low: Column, high: Column) -> Column:
    """The fewest dyadic intervals (level, number) that make up [low, high]: two of a level at most, so 40 for a million numbers.

    Interval ``number`` of a level holds the numbers from ``number << level`` on, ``1 << level`` of them.
    """

    def of(k: Column) -> Column:
        start, end = F.floor((low + _size(k) - 1) / _size(k)), F.floor((high + 1) / _size(k))
        left = F.when((start < end) & (start % 2 == 1), F.struct(k.alias("level"), start.alias("number")))
        right = F.when((start < end) & (end % 2 == 1), F.struct(k.alias("level"), (end - 1).alias("number")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of)), lambda x: x.isNotNull())


def _starts_inside(ranges: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of ``ranges`` (_low, _high) and ``points`` (_at) with the point in the range, by ``by`` and equality of dyadic intervals.

    A range's cover holds a point in one interval at most, and a point lies in one interval of each level; it is
    listed under the levels that covers of its group have.
    """
    covers = ranges.withColumn("_c", F.explode(dyadic_cover(F.col("_low"), F.col("_high"))))
    covers = covers.select("*", F.col("_c.level").alias("_level"), F.col("_c.number").alias("_number")).drop("_c", "_low", "_high")
    levels = covers.groupBy(*by).agg(F.collect_set("_level").alias("_levels"))
    listed = points.join(levels, by).withColumn("_level", F.explode("_levels")).drop("_levels")
    listed = listed.withColumn("_number", F.floor(F.col("_at") / _size(F.col("_level"))))
    return covers.join(listed, [*by, "_level", "_number"]).drop("_level", "_number")


def entries_for_passages(passages: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs of passages (group_key, urn, citation) and entries (group_key, work_urn, entry_citation, ...) that overlap.

    ``group_key`` is what both must share for their urns to be able to meet (the work, or namespace and group where
    entries name no more).  Leading numbers overlap where one begins inside the other: first the entries that begin
    in a passage, then the passages that begin in an entry, behind its first number.
    """
    low, high = _leading(F.col("citation"))
    left = passages.withColumns({"_low": low, "_high": high})
    low, high = _leading(F.col("entry_citation"))
    right = entries.withColumns({"_elow": low, "_ehigh": high})
    inside = _starts_inside(left, right.withColumn("_at", F.col("_elow")).drop("_elow", "_ehigh"), ["group_key"]).drop("_at")
    behind = right.withColumnsRenamed({"_elow": "_low", "_ehigh": "_high"}).withColumn("_low", F.col("_low") + 1).where("_low <= _high")
    around = _starts_inside(behind, left.withColumn("_at", F.col("_low")).drop("_low", "_high"), ["group_key"]).drop("_at")
    pairs = inside.unionByName(around)
    return pairs.where(prefixes_meet(F.col("work_urn"), F.col("urn")) & ranges_overlap(F.col("entry_citation"), F.col("citation")))


def links_for_passages(passages: DataFrame, links: DataFrame) -> DataFrame:
    """Commentary links (commentary, work_urn, line_ref, ...) of passages (group_key, urn, citation), overlapping as entries do."""
    entries = links.withColumnRenamed("line_ref", "entry_citation")
    return entries_for_passages(passages, entries).withColumnRenamed("entry_citation", "line_ref")


def link_groups(links: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Links of a passage by commentary, commentaries in order of first appearance, with their links in order."""
    listed = F.array_sort(F.collect_list(F.struct(pos, "line_ref", "target")))
    return links.groupBy(*by, "commentary").agg(F.min(pos).alias("first"), F.count("*").alias("n"), listed.alias("links"))


def footnote_numbers(nodes: DataFrame) -> DataFrame:
    """Notes of element nodes (doc, path, tag) with ``number``, from 1 in the order of their document."""
    order = Window.partitionBy("doc").orderBy("path")
    return nodes.where("tag = 'note'").withColumn("number", F.row_number().over(order).cast("long"))


def corresp_values(nodes: DataFrame) -> DataFrame:
    """(doc, path, reference): every reference of every element, inner and outer ones, in the order of the document."""
    given = F.filter(F.split(F.trim(F.coalesce("corresp", F.lit(""))), r"\s+"), lambda r: r != "")
    return nodes.select("doc", "path", F.explode(given).alias("reference"))


def entry_groups(entries: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Entries of a passage by author line (the source's label without authors), groups in order of first appearance."""
    label = F.coalesce(F.nullif(F.array_join("authors", ", "), F.lit("")), F.col("source_label"))
    return entries.withColumn("label", label).groupBy(*by, "label").agg(
        F.min(pos).alias("first"),
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct(pos, "body"))).alias("entries"),
    )


def citation_spans(values: DataFrame, by: list[str], value: str, citation: str) -> DataFrame:
    """(by, span): from the first start to the last end of the values of each chunk, qualified by the chunk's citation."""
    full = values.withColumn("_v", qualify(F.col(value), F.col(citation)))
    return full.groupBy(*by).agg(span(F.min_by("_v", start_key(F.col("_v"))), F.max_by("_v", end_key(F.col("_v")))).alias("span"))


def target_spans(values: DataFrame, by: list[str], reference: str, about: str) -> DataFrame:
    """Spans in the commented work's own citations; chunks without a reference to it are absent."""
    aimed = values.withColumn("_v", target_citation(F.col(reference), F.col(about))).where("_v is not null")
    return aimed.groupBy(*by).agg(span(F.min_by("_v", start_key(F.col("_v"))), F.max_by("_v", end_key(F.col("_v")))).alias("span"))


def citable_leaves(nodes: DataFrame) -> DataFrame:
    """Nodes (doc, enter, leave, tag, type, n) whose ``n`` is a citation: not a lyric division, and nothing that cites below them.

    What cites below a node would be the next citing node in the document's order, with a number that the node has
    not left yet, so one look ahead decides.
    """
    lyric = (F.col("tag") == "div") & F.col("type").isin(*LYRIC_DIVISIONS)
    citing = nodes.where((F.coalesce("n", F.lit("")) != "") & ~F.coalesce(lyric, F.lit(False)))
    ahead = F.lead("enter").over(Window.partitionBy("doc").orderBy("enter"))
    return citing.withColumn("_next", ahead).where("_next is null or _next > leave").drop("_next")


def chunk_of_anchor(anchors: DataFrame, chunk_ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """``anchors`` (version, anchor_id) with the chunk that holds the id, else the only chunk of its version, else null."""
    only = chunks.groupBy("version").agg(F.min("chunk").alias("_only"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    held = chunk_ids.groupBy("version", "anchor_id").agg(F.min("chunk").alias("_held"))
    return anchors.join(
        held,
        ["version", "anchor_id"],
        "left",
    ).join(only, "version", "left").withColumn("chunk", F.coalesce("_held", "_only")).drop("_held", "_only")
