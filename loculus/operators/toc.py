"""Tables of contents as node tables: (doc, node, parent, pos, urn, label, has_scheme, scheme)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def linked_entries(nodes: DataFrame, current: str = "") -> DataFrame:
    """``nodes`` with ``target``: the scheme an entry links to ("" is the default), null for entries without a link.

    An entry with its own scheme links there (nowhere if that is null); without
    one only leaves link, in the current scheme.
    """
    parents = nodes.where("parent is not null").select("doc", F.col("parent").alias("node")).distinct().withColumn("_inner", F.lit(True))
    target = F.when(F.col("has_scheme"), F.col("scheme")).when(F.col("_inner").isNull(), F.lit(current))
    return nodes.join(parents, ["doc", "node"], "left").withColumn("target", target).drop("_inner")


def tree_numbers(nodes: DataFrame) -> DataFrame:
    """``nodes`` (doc, node, parent, pos, ...) with ``enter`` and ``leave``: each entry's number in display order, and the last number below it.

    Contents of one document are numbered together; entries whose parent is missing stand on top, and such as lie in
    a circle have no number.
    """
    schema = T.StructType([*nodes.schema.fields, T.StructField("enter", T.LongType()), T.StructField("leave", T.LongType())])

    def number(table: pa.Table) -> pa.Table:
        names, above, place = (table.column(c).to_pylist() for c in ("node", "parent", "pos"))
        there, below, top = set(names), {}, []
        for k in sorted(range(len(names)), key=lambda k: (place[k] is None, place[k] or 0, names[k])):
            (below.setdefault(above[k], []) if above[k] in there else top).append(k)
        enter, leave, count = [None] * len(names), [None] * len(names), 0
        waiting = [(k, False) for k in reversed(top)]
        while waiting:
            k, done = waiting.pop()
            if done:
                leave[k] = count - 1
                continue
            enter[k], count = count, count + 1
            waiting.append((k, True))
            waiting += [(c, False) for c in reversed(below.get(names[k], []))]
        return table.append_column("enter", pa.array(enter, pa.int64())).append_column("leave", pa.array(leave, pa.int64()))

    return nodes.groupBy("doc").applyInArrow(number, schema)


def opened_path(numbered: DataFrame, urn: str) -> DataFrame:
    """(doc, node, steps): the current entry and its ancestors of numbered contents, those in whose range its number lies."""
    here = numbered.where(F.col("urn") == urn).select("doc", F.col("enter").alias("_at"))
    above = numbered.join(here, "doc").where("_at between enter and leave")
    nearer = Window.partitionBy("doc", "_at").orderBy(F.desc("enter"))
    return above.select("doc", "node", (F.row_number().over(nearer) - 1).alias("steps"))


def write_passages(chunks: DataFrame, path: str) -> str:
    """Store chunks (urn, ...) sorted by urn, in small row groups, so that a lookup reads those around its urns only."""
    small = {"compression": "zstd", "parquet.block.size": str(4 << 20), "parquet.page.row.count.limit": "1000"}
    chunks.repartitionByRange("urn").sortWithinPartitions("urn").write.options(**small).parquet(path)
    return path


def find_passages(stored_chunks: DataFrame, urns: Sequence[str]) -> DataFrame:
    """The stored chunks with one of a few urns; a urn that no version has gives no row."""
    return stored_chunks.where(F.col("urn").isin(*urns))


def scheme_names(files: DataFrame) -> DataFrame:
    """(version, scheme): schemes of a version that have an index, "" for the default, from paths ``version[/scheme]/index.json``."""
    inside = F.regexp_extract("path", r"^(?:[^/]+/)*?[^/]+/index\.json$", 0)
    below = F.substring_index(F.substring_index("path", "/index.json", 1), "/", -1)
    scheme = F.when(below == F.col("version"), "").otherwise(below)
    return files.where(inside != "").select("version", scheme.alias("scheme")).distinct()


def contents_of(sidecars: DataFrame, current: str = "") -> DataFrame:
    """Linked entries of the contents in JSON sidecars (version, json with a ``toc`` list of urn, label, parent, scheme); none where there is no list."""
    entry = "array<struct<urn:string,label:string,parent:int,scheme:string,has_scheme:boolean>>"
    opened = sidecars.select(F.col("version").alias("doc"), F.posexplode(F.from_json("json", f"toc {entry}")["toc"]).alias("node", "e"))
    nodes = opened.select(
        "doc",
        "node",
        "e.urn",
        "e.label",
        "e.parent",
        "e.scheme",
        F.coalesce("e.has_scheme", F.col("e.scheme").isNotNull()).alias("has_scheme"),
    )
    return linked_entries(nodes, current)
