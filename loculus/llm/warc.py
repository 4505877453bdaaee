"""Web archives as seekable Zstandard bundles.

Records (WARC 1.1) are grouped into frames that decompress on their own; a
file ends with a seek table in the seekable Zstandard format, a skippable
frame that lists the compressed and decompressed size of every frame.  The
writer also returns an index: record identifier to file, frame and offset
inside the decompressed frame.

Of records with equal payloads the one with the smallest page id is stored as
a ``response`` and the others as a ``revisit`` of it without a body.  Equality
is decided on SHA-1 and length by one aggregation with map-side combination; the
decision is joined back by digest, a join whose hot side Spark splits.  Pages are shuffled
once, by that join; files are written by the tasks that receive them.

Edge cases: a null payload is an empty one; a null URL becomes an empty target; a
null page_id is written as such, never first in its group unless all are null;
rows that repeat the smallest page_id of their payload are all responses; an
empty table writes no file.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import Scratch
from loculus.llm.files import new_file, one_file_a_task, open_file, slices

#: Decompressed bytes after which a frame is closed, and compressed bytes after which a file is.
FRAME_BYTES = 256 << 10
FILE_BYTES = 64 << 20
#: Payloads of at least so many bytes are stored once.
MIN_REVISIT_BYTES = 0
#: Fixed values of the Zstandard and seekable formats, and of WARC.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"

INDEX_SCHEMA = "file string, page_id long, record_id string, frame long, frame_offset long, record_bytes long"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string, frame long, frame_offset long"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(identifier: str) -> int | None:
    number = identifier[len("<urn:page:") : -1]
    return int(number) if number else None


def format_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit keeps the HTTP head (with the payload's length) and leaves the body out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at an offset of a decompressed frame, and where the next one starts."""
    head_end = data.index(b"\r\n\r\n", at)
    lines = data[at:head_end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    start = head_end + 4
    end = start + int(fields["Content-Length"])
    http_end = data.index(b"\r\n\r\n", start) + 4
    kind, payload = fields["WARC-Type"], data[http_end:end]
    if kind == "revisit":
        http = dict(line.split(": ", 1) for line in data[start : http_end - 4].decode().split("\r\n")[1:])
        size, digest = int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    else:
        size, digest = len(payload), payload_digest(payload)
        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    record = {
        "page_id": _page_id(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_id(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": None if kind == "revisit" else payload,
    }
    return record, end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The seekable format's last frame for (compressed, decompressed) sizes."""
    entries = b"".join(struct.pack("<II", *sizes) for sizes in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(source: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(position, compressed size, decompressed size) of each frame."""
    size = source.size()
    count, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entries = source.read_at(8 * count, size - 9 - 8 * count)
    frames, at = [], 0
    for compressed, plain in struct.iter_unpack("<II", entries):
        frames.append((at, compressed, plain))
        at += compressed
    return frames


def read_frame(source: pa.NativeFile, frame: tuple[int, int, int]) -> bytes:
    at, compressed, plain = frame
    return zstandard.ZstdDecompressor().decompress(source.read_at(compressed, at), max_output_size=plain)


def read_record(folder: str, file: str, frame: int, frame_offset: int) -> dict:
    """One record by its index entry; reads the seek table and a single frame."""
    with open_file(folder, file) as source:
        return parse_record(read_frame(source, read_seek_table(source)[frame]), frame_offset)[0]


class _BundleWriter:
    """Frames of one task's open file."""

    def __init__(self, folder: str, file_bytes: int, frame_bytes: int) -> None:
        self.folder, self.file_bytes, self.frame_bytes = folder, file_bytes, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        self.part, self.serial, self.context = TaskContext.get().partitionId() if TaskContext.get() else 0, 0, None
        self.pending: list[bytes] = []
        self.held = 0

    def add(self, record: bytes) -> tuple[str, int, int]:
        """Where the record goes: file, frame, offset in the frame."""
        if self.context is None:
            self.name = f"pages-{self.part:05d}-{self.serial:04d}.warc.zst"
            self.context = new_file(self.folder, self.name)
            self.out, self.frames, self.written = self.context.__enter__(), [], 0
        place = (self.name, len(self.frames), self.held)
        self.pending.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self._close_frame()
            if self.written >= self.file_bytes:
                self.close()
        return place

    def _close_frame(self) -> None:
        data = self.compress(b"".join(self.pending))
        self.out.write(data)
        self.frames.append((len(data), self.held))
        self.written += len(data)
        self.pending, self.held = [], 0

    def close(self) -> None:
        if self.context is not None:
            if self.pending:
                self._close_frame()
            self.out.write(seek_table(self.frames))
            self.context.__exit__(None, None, None)
            self.context, self.serial = None, self.serial + 1


def classify(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload and first_id: the response's page_id where the page revisits one, else null."""
    keyed = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    keyed = keyed.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload")})
    firsts = (
        keyed.where(F.col("bytes") >= min_bytes)
        .groupBy("digest", "bytes")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = keyed.join(firsts, ["digest", "bytes"], "left")
    # in a fixed order, so that a retried task writes the same bytes
    joined = joined.sortWithinPartitions("page_id", "digest", "url")
    own = F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", F.when(~own, F.col("first_id")).alias("first_id"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and return the index; the files exist once it has been evaluated."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _BundleWriter(folder, file_bytes, frame_bytes)
        for batch in slices(batches, "payload"):
            entries = []
            for page_id, url, payload, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first_id")), strict=True):
                record = format_record(page_id, url, payload, first, first is not None)
                entries.append((page_id, record_id(page_id), *writer.add(record), len(record)))
            page_ids, ids, files, frames, offsets, sizes = zip(*entries, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(files, pa.string()),
                    pa.array(page_ids, pa.int64()),
                    pa.array(ids, pa.string()),
                    pa.array(frames, pa.int64()),
                    pa.array(offsets, pa.int64()),
                    pa.array(sizes, pa.int64()),
                ],
                names=["file", "page_id", "record_id", "frame", "frame_offset", "record_bytes"],
            )
        writer.close()

    return classify(pages, min_bytes).mapInArrow(write, INDEX_SCHEMA)


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives named in ``files.file``; without ``payloads`` that column stays null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with open_file(folder, file) as source:
                    for number, frame in enumerate(read_seek_table(source)):
                        data, at, rows = read_frame(source, frame), 0, []
                        while at < len(data):
                            record, after = parse_record(data, at)
                            if not payloads:
                                record["payload"] = None
                            rows.append(record | {"file": file, "frame": number, "frame_offset": at})
                            at = after
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload", pa.binary()),
            ("file", pa.string()),
            ("frame", pa.int64()),
            ("frame_offset", pa.int64()),
        ]
    )
    return one_file_a_task(files).mapInArrow(read, RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, scratch: Scratch, folder: str | None = None, **options) -> DataFrame:
    """Write the archives, keep their index, and return the records read back from the files."""
    folder = folder or f"{scratch.path}/archives-{uuid.uuid4().hex[:8]}"
    index = scratch.table(write_archives(pages, folder, **options), "index")
    return read_archives(index.select("file").distinct(), folder, payloads=False)
