"""Archive files in the shared folder: written once under a final name, read by position.

A writer task streams into a name of its own and moves the finished file to
its final name, so readers never see a part of one.  A retried or speculative
task writes the same bytes; where the store refuses to move onto an existing
name (HDFS does) the file that stands there is removed first, or kept if another
attempt has put it back meanwhile.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs as pafs
from pyspark.sql import DataFrame


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute path; ``file:/x`` counts as ``file:///x``, Hadoop's ``s3a`` as ``s3``."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3://" + uri[6:]
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def new_file(folder: str, name: str) -> Iterator[pa.NativeFile]:
    """A file that appears as ``folder/name`` when the block ends without an error."""
    store, base = resolve(folder)
    store.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(draft) as out:
            yield out
        _put(store, draft, f"{base}/{name}")
    except BaseException:
        if store.get_file_info(draft).type != pafs.FileType.NotFound:
            store.delete_file(draft)
        raise


def _put(store: pafs.FileSystem, draft: str, final: str) -> None:
    """Move a finished draft to its final name, whether or not an earlier attempt left a file there."""
    try:
        store.move(draft, final)
    except OSError:
        if store.get_file_info(final).type != pafs.FileType.File:
            raise
        with suppress(FileNotFoundError):
            store.delete_file(final)
        try:
            store.move(draft, final)
        except OSError:  # another attempt was faster; its bytes are the same
            if store.get_file_info(final).type != pafs.FileType.File:
                raise
            store.delete_file(draft)


@contextmanager
def open_file(folder: str, name: str) -> Iterator[pa.NativeFile]:
    store, base = resolve(folder)
    with store.open_input_file(f"{base}/{name}") as source:
        yield source


def tidy() -> None:
    """Give memory that a finished task no longer uses back to the system; Python workers live on beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose ``column`` holds about ``most_bytes`` (one row at least)."""
    for batch in batches:
        size = pa.compute.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(size.tolist()):
            if i > start and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def one_file_a_task(files: DataFrame, most_tasks: int = 20_000) -> DataFrame:
    """Deal a list of files out to about as many tasks; it is too short for Spark to keep it spread."""
    return files.repartition(max(1, min(files.count(), most_tasks)))
