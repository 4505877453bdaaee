"""XML documents and their sidecars as tables: scanning, identifiers, element nodes, chunk indexes and tokens.

Scans are Spark file sources; parsing happens in tasks, one document at a time,
and never fails the job: every document comes back with a status.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loculus.sources.xml_source import CATALOG_FILE, ELEMENT, batches, elements, identifier

#: Elements beside the running text.
ASIDE = ("note", "app", "bibl")

CHUNK_INDEX = T.StructType(
    [T.StructField("chunks", T.ArrayType(T.StructType([T.StructField("cts_urn", T.StringType()), T.StructField("file", T.StringType())])))]
)
VERSION_METADATA = T.StructType(
    [
        T.StructField(
            "document",
            T.StructType(
                [T.StructField(c, T.StringType()) for c in ("title", "author", "language", "about", "base_urn", "source_repo", "source_path")]
                + [
                    T.StructField(
                        "editors",
                        T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("role", T.StringType())])),
                    )
                ]
            ),
        ),
        T.StructField("chunk_unit", T.StringType()),
    ]
)
TOKENS = T.StructType(
    [
        T.StructField("urn", T.StringType()),
        T.StructField(
            "tokens",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("text", T.StringType()),
                        T.StructField("urn", T.StringType()),
                        T.StructField("whitespace", T.BooleanType()),
                        T.StructField("start_char", T.IntegerType()),
                        T.StructField("end_char", T.IntegerType()),
                    ]
                )
            ),
        ),
    ]
)


def path_parts(path: Column, root: str) -> tuple[Column, Column]:
    """(repository, path inside it) of a file under ``root``; a ``data`` folder belongs to the path."""
    below = F.regexp_replace(path, r"^.*?" + "/".join(["", *root.rstrip("/").split("/")[-1:], ""]), "")
    return F.substring_index(below, "/", 1), F.regexp_replace(below, "^[^/]*/", "")


def find_documents(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """XML files below a folder of repositories: path, repo, rel_path and their bytes; catalogue files are left out.

    A repository with a ``data`` folder is read from there only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(root)
    repo, rel = path_parts(F.col("path"), root)
    found = files.where(F.substring_index("path", "/", -1) != CATALOG_FILE).select(
        "path",
        repo.alias("repo"),
        rel.alias("rel_path"),
        *(["content"] if content else []),
    )
    with_data = found.where("rel_path like 'data/%'").select("repo").distinct().withColumn("_data", F.lit(True))
    return found.join(with_data, "repo", "left").where("_data is null or rel_path like 'data/%'").drop("_data").select(
        "path",
        "repo",
        "rel_path",
        *(["content"] if content else []),
    )


def corpora(files: DataFrame) -> DataFrame:
    """(repo, root) of found documents in order: each repository's folder, or its ``data`` folder where it has one."""
    found = files.groupBy("repo").agg(F.max(F.col("rel_path").startswith("data/")).alias("_data"))
    return found.select("repo", F.when(F.col("_data"), F.concat("repo", F.lit("/data"))).otherwise(F.col("repo")).alias("root")).orderBy("repo")


def chunk_files(indexes: DataFrame, files: DataFrame) -> DataFrame:
    """(version, pos, cts_urn, file) of all schemes' chunk indexes (version, folder, json) whose file is among ``files`` (path)."""
    listed = indexes.select("version", "folder", F.posexplode(F.from_json("json", CHUNK_INDEX)["chunks"]).alias("pos", "c"))
    named = listed.select("version", "pos", "c.cts_urn", F.concat_ws("/", "folder", "c.file").alias("file"))
    return named.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select("version", "pos", "cts_urn", "file")


def primary_text(content: bytes) -> dict:
    """A compiled chunk's identifier and running text (apparatus and notes left out); an error where it has no content."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        return {"error": str(e)}
    body = root.find("elements")
    if body is None:
        return {"urn": root.get("cts_urn", ""), "error": "no content element"}
    parts, waiting = [], [(body, False)]
    while waiting:  # in the order of the document: an element's text, its children, its tail
        el, tail = waiting.pop()
        if tail:
            parts.append(el.tail or "")
        elif el.tag.rsplit("}", 1)[-1] not in ASIDE:
            parts.append(el.text or "")
            waiting += [x for child in reversed(el) for x in ((child, True), (child, False))]
    return {"urn": root.get("cts_urn", ""), "text": "".join(parts)}


_TEXTS = pa.struct([("urn", pa.string()), ("text", pa.string()), ("error", pa.string())])


@F.arrow_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("urn", "text", "error")]))
def chunk_text(contents: pa.Array) -> pa.Array:
    return pa.array([primary_text(c.as_py() or b"") for c in contents], _TEXTS)


def publication_info(nodes: DataFrame) -> DataFrame:
    """(doc, publisher, licence, source) from header nodes (doc, path, tag, text): the first of each that says anything."""
    said = nodes.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    first = lambda tag: F.min_by(F.when(F.col("tag") == tag, F.trim("text")), F.when(F.col("tag") == tag, F.col("path")))
    return said.groupBy("doc").agg(first("publisher").alias("publisher"), first("licence").alias("licence"), first("sourceDesc").alias("source"))


@F.arrow_udf(T.StringType())
def document_urn(contents: pa.Array) -> pa.Array:
    """The identifier of each document, null without one."""
    return pa.array([identifier(lambda c=c: iter([c.as_py() or b""])) for c in contents], pa.string())


def parse_documents(files: DataFrame) -> DataFrame:
    """Element nodes of ``files`` (doc, content), with the columns of the XML source; broken documents give one row with status failed."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for doc, content in zip(frame.column("doc").to_pylist(), frame.column("content"), strict=True):
                data = content.as_py() or b""
                yield from batches(elements(lambda data=data: iter([data])), {"doc": doc}, schema)

    kinds = f"doc string, {ELEMENT}"
    schema = to_arrow_schema(T.StructType.fromDDL(kinds))
    return files.select("doc", "content").mapInArrow(run, kinds)


def compile_status(files: DataFrame, done: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, status): skipped without urn or if done, failed if broken, no-schema without divisions, else ok."""
    state = nodes.groupBy("doc").agg(
        F.max(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("broken"),
        F.count_if(F.col("tag") == "div").alias("divs"),
    )
    joined = files.select("doc", "urn").join(done.select("doc").distinct().withColumn("_done", F.lit(True)), "doc", "left").join(state, "doc", "left")
    status = F.when(F.col("broken") == 1, "failed").when(
        F.col("urn").isNull() | F.col("_done").isNotNull(),
        "skipped",
    ).when(F.col("divs") == 0, "no-schema").otherwise("ok")
    return joined.select("doc", status.alias("status"))


def chunk_index(indexes: DataFrame) -> DataFrame:
    """(version, pos, cts_urn, file) of JSON indexes (version, json), in document order."""
    return indexes.select(
        "version",
        F.from_json("json", CHUNK_INDEX).alias("j"),
    ).select("version", F.posexplode("j.chunks").alias("pos", "c")).select("version", "pos", "c.*")


def version_metadata(sidecars: DataFrame) -> DataFrame:
    """(version, document fields, chunk_unit) of JSON sidecars (version, json)."""
    return sidecars.select("version", F.from_json("json", VERSION_METADATA).alias("j")).select(
        "version",
        "j.document.*",
        F.coalesce("j.chunk_unit", F.lit("")).alias("chunk_unit"),
    )


def decoded(content: bytes | None) -> str | None:
    """A sidecar's JSON: Zstandard if it begins so, else plain text; None if it can't be read."""
    if not content:
        return None
    try:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(content) if content[:4] == b"\x28\xb5\x2f\xfd" else content
        json.loads(data)
        return data.decode()
    except (zstandard.ZstdError, ValueError):
        return None


@F.arrow_udf(T.StringType())
def sidecar_json(contents: pa.Array) -> pa.Array:
    return pa.array([decoded(c.as_py()) for c in contents], pa.string())


def token_sidecars(chunks: DataFrame, outer: DataFrame, beside: DataFrame, plain: DataFrame) -> DataFrame:
    """(chunk, origin, tokens): from the outer tree, else beside the chunk, else the old plain file, else null.

    The three are frames (chunk, content).
    """
    out = chunks.select("chunk")
    for name, frame in (("outer", outer), ("beside", beside), ("plain", plain)):
        out = out.join(frame.select("chunk", F.col("content").alias(f"_{name}")), "chunk", "left")
    origin = F.when(F.col("_outer").isNotNull(), "outer").when(F.col("_beside").isNotNull(), "beside").when(F.col("_plain").isNotNull(), "plain")
    read = out.select("chunk", origin.alias("origin"), sidecar_json(F.coalesce("_outer", "_beside", "_plain")).alias("json"))
    return read.select("chunk", "origin", F.from_json("json", TOKENS)["tokens"].alias("tokens"))
