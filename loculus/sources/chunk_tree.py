"""The tree of compiled chunks: one file per chunk in its version's folder, with the index and the metadata beside them.

``<namespace>/<group>/<work>/<version>[/<scheme>]/`` holds the chunks, an
``index.json`` that lists them in order, and a ``metadata.json`` that says which
repository they came from.  Files are written by tasks, each under a name of its
own and then moved to its final one, so a repeated task does no harm; only the
names of a version's chunks are gathered for its index.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loculus.functions.citekey import passage
from loculus.functions.urn import chunk_folder
from loculus.operators.publish import record_source
from loculus.sources.xml_source import file_store

#: The files beside the chunks, and how a chunk's file is named behind its passage.
INDEX, METADATA, SUFFIX = "index.json", "metadata.json", ".xml"
WRITTEN = "path string, bytes long"


def _put(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Write (path, content) rows below ``root``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_store(root)
        for batch in batches:
            done = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data, folder = content.as_py() or b"", f"{base}/{path}".rsplit("/", 1)[0]
                store.create_dir(folder, recursive=True)
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(data)
                _move(store, draft, f"{base}/{path}")
                done.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(done, pa.int64())], ["path", "bytes"])

    return write


def _move(store: pafs.FileSystem, draft: str, final: str) -> None:
    """Move a draft to its final name; stores that don't replace a file have it removed first."""
    try:
        store.move(draft, final)
    except OSError:
        if store.get_file_info(final).type != pafs.FileType.File:
            raise
        store.delete_file(final)
        store.move(draft, final)


def tree_files(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """(path, content) of the tree of ``chunks`` (urn, scheme, pos, cts_urn, content) and ``metadata`` (urn, json, source_repo, source_path).

    The index and the metadata of a version lie in the folder of each of its schemes.
    """
    folder = chunk_folder(F.col("urn"), F.col("scheme"))
    named = chunks.select("urn", "scheme", "pos", "cts_urn", folder.alias("folder"), F.concat(passage(F.col("cts_urn")), F.lit(SUFFIX)).alias("file"), "content")
    bodies = named.select(F.concat_ws("/", "folder", "file").alias("path"), F.col("content").cast("binary").alias("content"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "cts_urn", "file")))
    entries = F.transform(listed, lambda c: F.struct(c["cts_urn"].alias("cts_urn"), c["file"].alias("file")))
    index = named.groupBy("urn", "folder").agg(F.to_json(F.struct(entries.alias("chunks"))).alias("json"))
    about = record_source(metadata).select("urn", F.to_json(F.struct("document")).alias("about"))
    both = index.join(about, "urn", "left").select(
        F.explode(F.array(F.struct(F.lit(INDEX).alias("name"), F.col("json").alias("text")), F.struct(F.lit(METADATA).alias("name"), F.col("about").alias("text")))).alias("f"), "folder"
    )
    beside = both.where("f.text is not null").select(F.concat_ws("/", "folder", "f.name").alias("path"), F.col("f.text").cast("binary").alias("content"))
    return bodies.unionByName(beside)


def write_chunk_tree(chunks: DataFrame, metadata: DataFrame, root: str) -> DataFrame:
    """Write the tree below ``root`` (a folder that all executors reach); returns (path, bytes) of what is written when it is evaluated."""
    return tree_files(chunks, metadata).mapInArrow(_put(root), WRITTEN)


Tokenizer = Callable[[str, str], list[dict]]
TOKENIZED = "chunk string, status string, error string, json string"


def tokenize_chunks(chunks: DataFrame, tokenizer: Tokenizer, done: DataFrame | None = None, force: bool = False) -> DataFrame:
    """(chunk, status, error, json) of ``chunks`` (chunk, urn, text): generated, skipped if ``done`` has the chunk, or failed.

    ``tokenizer`` (urn, text) asks the service.  Where it can't be reached (a ``ConnectionError``) the task ends with that
    error and Spark stops the job once its attempts are used up: nothing more is asked, and no outcome is reported.
    A blank text has no tokens and isn't asked for; any other error fails its chunk only.
    """
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk, urn, text in zip(*(batch.column(c).to_pylist() for c in ("chunk", "urn", "text")), strict=True):
                try:
                    tokens = tokenizer(urn, text) if (text or "").strip() else []
                    out.append((chunk, "generated", None, json.dumps({"urn": urn, "tokens": tokens}, ensure_ascii=False)))
                except ConnectionError as e:
                    raise ConnectionError(f"the tokenizing service was not reached: {e}") from e
                except Exception as e:  # noqa: BLE001 - whatever is wrong with one chunk is told of and left out
                    out.append((chunk, "failed", str(e), None))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)] or [pa.array([], pa.string())] * 4, TOKENIZED.replace(" string", "").split(", "))

    known = None if force or done is None else done.select("chunk").distinct()
    asked = chunks if known is None else chunks.join(known, "chunk", "left_anti")
    found = asked.select("chunk", "urn", "text").mapInArrow(run, TOKENIZED)
    if known is None:
        return found
    none = F.lit(None).cast("string")
    return found.unionByName(chunks.join(known, "chunk", "left_semi").select("chunk", F.lit("skipped").alias("status"), none.alias("error"), none.alias("json")))
