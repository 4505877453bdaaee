"""XML documents as a Spark data source: a partition per file, filters on paths before any file is opened, parsing by events.

``spark.read.format("cited_xml").load(root)`` gives the elements of all XML files
below a folder of repositories, each with its place in the tree: its number in
the order of the document (``enter``), and the last number of what lies in it
(``leave``), so that what is below or above an element is a range of numbers.
A document is read in pieces and an element is handed on when it ends, so memory
holds the open elements and one batch of rows, however long the document is.

With the option ``rows`` set to ``documents`` there is one row per file, with its
identifier, for which reading stops at the first that is found.

Broken documents are never fatal: they are read once to the end before rows are
made of them, and give one row with the status ``failed``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

#: The catalogue file that is no document, the attributes that name things, how an identifier begins.
CATALOG_FILE = "__cts__.xml"
XML_ID, XML_BASE = "http://www.w3.org/XML/1998/namespace}id", "http://www.w3.org/XML/1998/namespace}base"
URN_PREFIX = "urn:cts:"
#: Bytes that are read together, rows of a batch, bytes of small files that share a partition.
PIECE, BATCH_ROWS, PARTITION_BYTES = 1 << 20, 4096, 8 << 20

ELEMENT = (
    "status string, error string, enter long, leave long, parent long, depth int, path array<int>, "
    "tag string, type string, n string, corresp string, text string, ids array<string>"
)
PLACE = "file string, repo string, rel_path string, version string"
Pieces = Callable[[], Iterator[bytes]]


@dataclass
class _Open:
    """An element whose end hasn't come."""

    enter: int
    path: list[int]
    tag: str
    attributes: dict[str, str]
    text: list[str] = field(default_factory=list)
    children: int = 0


def failure(pieces: Pieces) -> str | None:
    """Why a document can't be read, or None."""
    parser = expat.ParserCreate(namespace_separator="}")
    try:
        for piece in pieces():
            parser.Parse(piece, False)
        parser.Parse(b"", True)
    except expat.ExpatError as e:
        return str(e)
    return None


def elements(pieces: Pieces) -> Iterator[dict]:
    """Rows of a document's elements as they end; a single failed row if the document is broken."""
    error = failure(pieces)
    if error is not None:
        yield {"status": "failed", "error": error}
        return
    waiting: list[_Open] = []
    ended: list[dict] = []
    number = 0

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal number
        place = 0
        if waiting:
            place = waiting[-1].children
            waiting[-1].children += 1
        above = waiting[-1].path if waiting else []
        waiting.append(_Open(number, [*above, place], name.rsplit("}", 1)[-1], attributes))
        number += 1

    def end(_: str) -> None:
        el = waiting.pop()
        own = el.attributes.get(XML_ID)
        ended.append({
            "status": "ok",
            "enter": el.enter,
            "leave": number - 1,
            "parent": waiting[-1].enter if waiting else None,
            "depth": len(waiting),
            "path": el.path,
            "tag": el.tag,
            **{c: el.attributes.get(c) for c in ("type", "n", "corresp")},
            "text": "".join(el.text),
            "ids": [own] if own else [],
        })

    def characters(data: str) -> None:
        if waiting:
            waiting[-1].text.append(data)

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    for piece in pieces():
        parser.Parse(piece, False)
        yield from ended
        ended.clear()
    parser.Parse(b"", True)
    yield from ended


def identifier(pieces: Pieces) -> str | None:
    """The identifier of a document: its body's base, else the first division's number, if it is a urn; nothing behind it is read."""
    found: list[str] = []

    def start(name: str, attributes: dict[str, str]) -> None:
        tag = name.rsplit("}", 1)[-1]
        value = attributes.get(XML_BASE) if tag == "body" else attributes.get("n") if tag == "div" else None
        if value and value.startswith(URN_PREFIX):
            found.append(value)

    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler = start
    try:
        for piece in pieces():
            parser.Parse(piece, False)
            if found:
                break
    except expat.ExpatError:
        pass  # what stands before the break counts
    return found[0] if found else None


def batches(rows: Iterator[dict], place: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with what is the same for all of them, in batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(place | row)
        size += len(row.get("text") or "")
        if len(held) == BATCH_ROWS or size > PIECE:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


@dataclass
class Files(InputPartition):
    """Files (path, repo, rel_path) that one task reads."""

    files: list[tuple[str, str, str]]


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".xml")


class CitedXmlReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.root, self.kind, self.schema = options["path"], options.get("rows", "elements"), schema
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equality, membership and beginnings of repo, rel_path and version choose files; all else is left to Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in ("repo", "rel_path", "version") and isinstance(f, EqualTo | In | StringStartsWith):
                values = f.value if isinstance(f, In) else (f.value,)
                self.wanted.append((column, "starts" if isinstance(f, StringStartsWith) else "is", tuple(values)))
            else:
                yield f

    def _chosen(self, repo: str, rel_path: str) -> bool:
        have = {"repo": repo, "rel_path": rel_path, "version": _stem(rel_path)}
        return all(have[c].startswith(values) if how == "starts" else have[c] in values for c, how, values in self.wanted)

    def _listed(self) -> list[tuple[str, str, str, int]]:
        """(path, repo, rel_path, size) of XML files; a repository with a ``data`` folder is read from there only."""
        store, base = file_store(self.root)
        base = base.rstrip("/")
        found = []
        for info in store.get_file_info(pafs.FileSelector(base, recursive=True)):
            repo, _, rel_path = info.path[len(base) + 1 :].partition("/")
            if info.is_file and rel_path.endswith(".xml") and not rel_path.endswith(CATALOG_FILE):
                found.append((info.path, repo, rel_path, info.size))
        with_data = {repo for _, repo, rel_path, _ in found if rel_path.startswith("data/")}
        return sorted(f for f in found if f[1] not in with_data or f[2].startswith("data/"))

    def partitions(self) -> list[Files]:
        out, size = [], PARTITION_BYTES
        for path, repo, rel_path, n in self._listed():
            if not self._chosen(repo, rel_path):
                continue
            if size + n > PARTITION_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].files.append((path, repo, rel_path))
            size += n
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        store, schema = file_store(self.root)[0], to_arrow_schema(self.schema)
        for path, repo, rel_path in partition.files:
            pieces = _reader(store, path)
            place = {"file": path, "repo": repo, "rel_path": rel_path, "version": _stem(rel_path)}
            rows = iter([{"urn": identifier(pieces)}]) if self.kind == "documents" else elements(pieces)
            yield from batches(rows, place, schema)


def file_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _reader(store: pafs.FileSystem, path: str) -> Pieces:
    def pieces() -> Iterator[bytes]:
        with store.open_input_stream(path) as source:
            while piece := source.read(PIECE):
                yield piece

    return pieces


class CitedXml(DataSource):
    """Options: ``path``, a folder of repositories, and ``rows``, ``elements`` (the default) or ``documents``."""

    @classmethod
    def name(cls) -> str:
        return "cited_xml"

    def schema(self) -> str:
        return f"{PLACE}, urn string" if self.options.get("rows") == "documents" else f"{PLACE}, {ELEMENT}"

    def reader(self, schema) -> CitedXmlReader:
        return CitedXmlReader(dict(self.options), schema)


def read_elements(spark: SparkSession, root: str, rows: str = "elements") -> DataFrame:
    """The elements (or the documents) of the XML files below a folder of repositories; set filters on repo, rel_path or version.

    The session must have ``spark.sql.python.filterPushdown.enabled`` set when the plan is made (``session.SETTINGS`` has it).
    """
    spark.dataSource.register(CitedXml)
    return spark.read.format("cited_xml").option("rows", rows).load(root)
