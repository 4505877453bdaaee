"""Token-id files: documents compressed one by one with a shared Zstandard dictionary.

Documents are range-sorted by id (rows that share one are dealt over ranges by
number, so a hot id is no hot task), tokenized with the ``tokenizers`` library and
written in that order.  A file holds

* a head: magic, width of an id in bytes, SHA-256 of the dictionary,
* one Zstandard frame per document over its little-endian ids,
* an index: doc_id, position, compressed size and number of ids per document,
* a tail: position of the index, number of documents, magic,

so a short document is one positioned read.  The dictionary is trained on
serialized id arrays of a bounded sample (``SAMPLE_DOCUMENTS`` documents with the
smallest hashes, up to ``SAMPLE_IDS`` ids of each, taken in windows that are spread
evenly over the whole document); it is stored beside the files, has a bounded size
and goes to the tasks with the writing function.

The library encodes each distinct word (run of characters between ASCII white
space) once per batch and worker: its normalizer and splitter never look across
white space, so a document's ids are its words' ids in order.  New words of
lower-case letters go to the library's model directly, all others through the
whole tokenizer.

Edge cases: a null or empty text has the end id only; rows with a null id come
first; rows with the same id are ordered by the first ``ORDER_CHARS`` characters of
their texts and otherwise by chance; an empty table writes no file.  Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loculus.llm.bpe import byte_characters
from loculus.llm.common import Scratch
from loculus.llm.files import new_file, one_file_a_task, open_file, slices

SAMPLE_DOCUMENTS = 2_000
SAMPLE_IDS, SAMPLE_WINDOW = 2_048, 256
DICTIONARY_BYTES = 64 << 10
#: Characters that order the texts of one id.
ORDER_CHARS = 32
#: Compressed bytes after which a new file begins, and words that a worker remembers.
FILE_BYTES = 128 << 20
REMEMBERED_WORDS = 800_000
MAGIC = b"IDZ1"
#: ASCII that is neither a letter, a digit, white space nor part of a contraction: a run of it at a word's end is a piece of its own.
_CLOSING = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")
_HEAD, _TAIL = "<4sB32s", "<QQ4s"
_INDEX = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("at", "<u8"), ("size", "<u4"), ("ids", "<u4")])


def _is_letters(word: bytes) -> bool:
    """Whether it consists of lower-case letters in composed form."""
    if word.isascii():
        return word.isalpha() and word.islower()
    text = word.decode()
    return text.isalpha() and text.islower() and is_normalized("NFC", text)


class WordTokenizer:
    """The library's tokenizer, with a bounded memory of words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        #: Whether a word of lower-case letters is one piece that the model can have as it is, spelled in byte letters.
        self.direct = self.lower and "ByteLevel" in str(self.tokenizer.pre_tokenizer) and "add_prefix_space=False" in str(self.tokenizer.pre_tokenizer)
        self.byte_letters = dict(enumerate(byte_characters()))
        self.words: dict[bytes, bytes] = {}

    def _encode_letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of lower-case letters: nothing is left to normalize or split, so they go straight to the library's model."""
        tokenize, code = self.tokenizer.model.tokenize, {2: "H", 4: "I"}[self.width]
        spelled = (w.decode() if w.isascii() else w.decode("latin-1").translate(self.byte_letters) for w in words)
        return [array(code, [t.id for t in tokenize(w)]).tobytes() for w in spelled]

    def _encode_each(self, words: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]

    def _learn(self, missing: set[bytes]) -> None:
        known, closed = self.words, []
        letters, others = set(), set()
        for word in missing:
            stem = word.rstrip(_CLOSING)
            if len(stem) < len(word) and stem[-1:].isalpha() and b"<|" not in word:
                closed.append((word, stem, word[len(stem) :]))
            else:
                stem = word
            (letters if self.direct and _is_letters(stem) else others).add(stem)
        others.update(tail for _, _, tail in closed)
        letters, others = [w for w in letters if w not in known], [w for w in others if w not in known]
        known.update(zip(letters, self._encode_letters(letters), strict=True))
        known.update(zip(others, self._encode_each(others), strict=True))
        known.update((word, known[stem] + known[tail]) for word, stem, tail in closed)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Serialized ids of each text."""
        data = [(t or "").encode() for t in texts]
        if self.lower:  # added tokens are looked for before the library lowers letters
            data = [d if b"<|" in d else d.lower() for d in data]
        words = [d.split() for d in data]
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        self._learn({w for document in words for w in document}.difference(self.words))
        find = self.words.__getitem__
        return [b"".join(map(find, document)) for document in words]


@lru_cache(maxsize=4)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def spread_windows(ids: bytes, width: int) -> bytes:
    """At most ``SAMPLE_IDS`` serialized ids, in windows spread evenly over all of them."""
    n = len(ids) // width
    if n <= SAMPLE_IDS:
        return ids
    starts = np.linspace(0, n - SAMPLE_WINDOW, SAMPLE_IDS // SAMPLE_WINDOW).astype(int).tolist()
    return b"".join(ids[a * width : (a + SAMPLE_WINDOW) * width] for a in starts)


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """A Zstandard dictionary for serialized id arrays; empty where there is too little to train on."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        for batch in slices(batches, "text"):
            data = [spread_windows(d, tokenizer.width) for d in tokenizer.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["data"])

    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most SAMPLE_DOCUMENTS ids are broadcast
    single = chosen.groupBy("doc_id").agg(F.min("text").alias("text"))  # rows may share an id
    # the driver sorts what it has fetched, so a sort in Spark doesn't sample, and so tokenize, twice
    samples = sorted(bytes(r.data) for r in single.select("text").mapInArrow(sample, "data binary").collect())
    samples = [s for s in samples if len(s) >= 8]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 512:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:  # too uniform for the trainer
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


MANIFEST = "file string, documents long, ids long, bytes long"


def write_id_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, dictionary: bytes, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files and return one manifest row for each; file names sort in document order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, serial = load(tokenizer_path), TaskContext.get().partitionId(), 0
        shared = _dictionary(dictionary)
        compress = (zstandard.ZstdCompressor(level=3, dict_data=shared) if shared else zstandard.ZstdCompressor(level=3)).compress
        end = np.array([end_id], tokenizer.dtype).tobytes()
        pending = slices(batches, "text")
        batch = next(pending, None)
        while batch is not None:
            name, index = f"ids-{part:06d}-{serial:04d}.idz", []
            with new_file(folder, name) as out:
                out.write(struct.pack(_HEAD, MAGIC, tokenizer.width, hashlib.sha256(dictionary).digest()))
                while batch is not None and out.tell() < file_bytes:
                    for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encode(batch.column("text").to_pylist()), strict=True):
                        frame = compress(ids + end)
                        index.append((doc_id is not None, doc_id or 0, out.tell(), len(frame), len(ids) // tokenizer.width + 1))
                        out.write(frame)
                    batch = next(pending, None)
                entries, at = np.array(index, _INDEX), out.tell()
                out.write(entries.tobytes())
                out.write(struct.pack(_TAIL, at, len(entries), MAGIC))
                row = [name, len(entries), int(entries["ids"].sum(dtype=np.int64)), out.tell()]
            serial += 1
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["file", "documents", "ids", "bytes"])

    numbered = docs.select(
        "doc_id",
        "text",
        F.left(F.coalesce("text", F.lit("")), F.lit(ORDER_CHARS)).alias("head"),
        F.xxhash64(F.monotonically_increasing_id()).alias("number"),
    )
    ordered = numbered.repartitionByRange("doc_id", "head", "number").sortWithinPartitions("doc_id", "head", "number")
    return ordered.select("doc_id", "text").mapInArrow(write, MANIFEST)


class IdFile:
    """An open file: its index, and documents by row."""

    def __init__(self, source: pa.NativeFile, dictionary: bytes) -> None:
        self.source = source
        magic, width, digest = struct.unpack(_HEAD, source.read_at(struct.calcsize(_HEAD), 0))
        at, count, tail = struct.unpack(_TAIL, source.read_at(struct.calcsize(_TAIL), source.size() - struct.calcsize(_TAIL)))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError("no token-id file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("written with another dictionary")
        self.dtype = np.dtype(f"<u{width}")
        self.index = np.frombuffer(source.read_at(count * _INDEX.itemsize, at), _INDEX)
        shared = _dictionary(dictionary)
        self.decompress = (zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()).decompress

    def document(self, row: int) -> np.ndarray:
        entry = self.index[row]
        return np.frombuffer(self.decompress(self.source.read_at(int(entry["size"]), int(entry["at"]))), self.dtype)

    def runs(self, most_bytes: int = 4 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
        """All documents in order, as (first row, documents), with one read per run of rows."""
        ends = np.cumsum(self.index["size"], dtype=np.int64)
        start = 0
        while start < len(self.index):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_bytes, "right")))
            base = int(self.index["at"][start])
            data = self.source.read_at(int(self.index["at"][stop - 1]) + int(self.index["size"][stop - 1]) - base, base)
            places = zip((self.index["at"][start:stop].astype(np.int64) - base).tolist(), self.index["size"][start:stop].tolist(), strict=True)
            yield start, [np.frombuffer(self.decompress(data[at : at + size]), self.dtype) for at, size in places]
            start = stop


def read_id_files(manifest: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document; ``start`` counts the ids of all documents before it."""
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("file_start", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).cast("long")).select("file", "file_start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, file_start in zip(batch.column("file").to_pylist(), batch.column("file_start").to_pylist(), strict=True):
                with open_file(folder, file) as source:
                    opened = IdFile(source, dictionary)
                    counts = opened.index["ids"].astype(np.int64)
                    begin = file_start + np.cumsum(counts) - counts
                    for first, documents in opened.runs():
                        rows = slice(first, first + len(documents))
                        wide = [d.astype("<u4") for d in documents]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(opened.index["doc_id"][rows], mask=opened.index["has_id"][rows] == 0),
                                pa.array(begin[rows]),
                                pa.array(np.array([len(d) for d in documents], np.int64)),
                                pa.array(np.array([zlib.crc32(d.tobytes()) for d in wide], np.int64)),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return one_file_a_task(starts).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def id_file_round_trip(docs: DataFrame, scratch: Scratch, tokenizer_path: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Train the dictionary, write the files, and describe every document as read back from them."""
    folder = folder or f"{scratch.path}/ids"
    dictionary = train_dictionary(docs, tokenizer_path)
    with new_file(folder, "dictionary") as out:
        out.write(dictionary)
    manifest = scratch.table(write_id_files(docs, folder, tokenizer_path, end_id, dictionary), "manifest")
    return read_id_files(manifest, folder, dictionary)
