r"""Markdown commentary: files with a leading block of fields, entries between lines of three dashes.

An entry begins with an anchor line ``@urn:cts:...:<citation>``; ``:key: value``
lines may follow, then the body.  A heading on a part's first line names the section
of the entries that follow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HEAD = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)"


def read_markdown(spark: SparkSession, *folders: str) -> DataFrame:
    """file and text of the Markdown files right inside the folders."""
    files = spark.read.option("pathGlobFilter", "*.md").text(list(folders), wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def head_and_body(text: Column) -> tuple[Column, Column]:
    """The first block of fields ("" without one) and what follows it."""
    return F.regexp_extract(text, _HEAD, 1), F.regexp_replace(text, _HEAD, "")


def _field(head: Column, name: str) -> Column:
    value = F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(\S.*)$", 1))
    return F.nullif(F.regexp_replace(value, r"""^["']|["']$""", ""), F.lit(""))


def authors(head: Column) -> Column:
    """The list under ``authors``, else the single ``author``, else none."""
    listed = F.regexp_extract_all(
        F.regexp_extract(head, r"(?m)^authors:[ \t]*\n((?:[ \t]*-[ \t]*\S[^\n]*\n?)+)", 1),
        F.lit(r"(?m)^[ \t]*-[ \t]*(\S[^\n]*?)[ \t]*$"),
        F.lit(1),
    )
    inline = F.transform(F.split(F.regexp_extract(head, r"(?m)^authors:[ \t]*\[(.*)\]", 1), ","), lambda a: F.trim(a))
    some = F.filter(F.concat(listed, inline), lambda a: a != "")
    one = _field(head, "author")
    return F.when(F.size(some) > 0, some).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def absolute_images(markdown: Column, base: Column) -> Column:
    """Root-relative image sources get the site's address."""
    html = F.regexp_replace(markdown, r"""(src=["'])(/[^"']*)(["'])""", F.concat(F.lit("$1"), base, F.lit("$2$3")))
    return F.regexp_replace(html, r"(!\[[^\]]*\]\()(/[^)\s]*)", F.concat(F.lit("$1"), base, F.lit("$2")))


def entries(files: DataFrame, site: Column | None = None) -> DataFrame:
    """One row per entry of ``files`` (file, text): file, pos, work_urn, citation, authors, section, metadata, body, source_label, source_url."""
    head, body = head_and_body(F.regexp_replace("text", "\r\n?", "\n"))
    site = F.lit("") if site is None else site
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"\.md$", "")
    whole = files.select(
        "file",
        site.alias("source_url"),
        authors(head).alias("authors"),
        F.coalesce(_field(head, "shortname"), stem).alias("source_label"),
        F.split(F.concat(F.lit("\n"), body, F.lit("\n")), r"\n---[ \t]*(?=\n)").alias("parts"),
    )
    parts = whole.select("*", F.posexplode("parts").alias("pos", "part")).drop("parts").withColumn(
        "part",
        F.regexp_replace("part", r"\A\s+|\s+\z", ""),
    ).where("part <> ''")
    first = F.trim(F.substring_index("part", "\n", 1))
    heading = F.nullif(F.regexp_extract(first, r"^#+\s+(.*\S)", 1), F.lit(""))
    carried = F.last(heading, ignorenulls=True).over(Window.partitionBy("file").orderBy("pos"))
    anchored = parts.withColumns({"section": carried, "anchor": F.regexp_extract(first, r"^@(urn:cts:\S+)", 1)}).where("anchor <> ''")
    rest = F.regexp_replace("part", r"\A[^\n]*\n?", "")
    fields = F.regexp_extract(rest, r"\A((?:\s*:[^:\n]+:[^\n]*(?:\n|\z))*)", 1)
    pairs = F.transform(
        F.regexp_extract_all(fields, F.lit(r"(?m)^\s*(:[^:\n]+:[^\n]*)$"), F.lit(1)),
        lambda p: F.struct(F.regexp_extract(p, "^:([^:]+):", 1).alias("k"), F.trim(F.regexp_replace(p, "^:[^:]+:", "")).alias("v")),
    )
    text = F.regexp_replace(F.substr(rest, F.length(fields) + 1), r"\A\s+|\s+\z", "")
    return anchored.select(
        "file",
        "pos",
        F.regexp_replace("anchor", ":[^:]*$", "").alias("work_urn"),
        F.substring_index("anchor", ":", -1).alias("citation"),
        "authors",
        "section",
        F.map_from_entries(pairs).alias("metadata"),
        absolute_images(text, F.col("source_url")).alias("body"),
        "source_label",
        "source_url",
    )
