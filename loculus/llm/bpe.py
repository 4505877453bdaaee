"""Byte-level BPE encoding and decoding with a contiguous rank array.

Texts are cut into words by the usual byte-level pattern.  A short word holds
its parts in an array, next to it the merge ranks of adjacent parts; the
smallest rank (leftmost on ties) is looked for again and again, the boundary
there is deleted and the ranks of the two neighbours are refreshed.  Words of
one length are merged together, one numpy row each: after k merges every row
that is still active has k parts less, so a batch stays one dense matrix.
Words above ``SHORT_WORD`` bytes use a heap over the same ranks, because
scanning grows with the square of the length.

Vocabulary, merges and added tokens come from a ``tokenizers`` JSON file whose
path is a parameter.  Each Python worker reads it once and keeps a bounded
memory of the words that a task has encoded.

Edge cases: a null or empty text has no ids and decodes to the empty text; an
added token's string in a text becomes its id; bytes that are no UTF-8 after
decoding chosen ids become U+FFFD; any other column is carried along by the
caller, not by these functions.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loculus.llm.files import slices, tidy

#: Bytes of a word up to which it is merged by scanning; longer ones use a heap.
SHORT_WORD = 48
#: Words that a worker remembers before it starts anew.
REMEMBERED_WORDS = 200_000
#: Fixed value: how the byte-level pre-tokenizer splits.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.iinfo(np.int32).max


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    characters = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [characters[b] for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary with its merge ranks."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"] != {
            "type": "ByteLevel",
            "add_prefix_space": False,
            "trim_offsets": True,
            "use_regex": True,
        }:
            raise ValueError(f"{path} is no plain byte-level BPE")
        vocab = model["vocab"]
        characters = byte_characters()
        to_byte = {c: b for b, c in enumerate(characters)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.added_split = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.size = max([*vocab.values(), *added.values()]) + 1
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for c in characters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order.astype(np.int32), np.int32(_NONE))
        self.words: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN).findall

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each adjacent pair, or the largest int32 where there is no merge."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.key_ranks[at], np.int32(_NONE))

    def _merge_equal_lengths(self, words: list[bytes]) -> list[bytes]:
        """Ids (int32 bytes) of short words of one length, by their contiguous rank arrays."""
        width = len(words[0])
        parts = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)].reshape(len(words), width)
        rows = np.arange(len(words))
        out: list[bytes] = [b""] * len(words)

        def finish(which: np.ndarray, ids: np.ndarray) -> None:
            data, step = ids.tobytes(), 4 * ids.shape[1]
            for k, row in enumerate(which.tolist()):
                out[row] = data[k * step : (k + 1) * step]

        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while width > 1 and len(rows):
            best = ranks.argmin(axis=1)
            lowest = np.take_along_axis(ranks, best[:, None], 1)[:, 0]
            active = lowest < _NONE
            if not active.all():
                finish(rows[~active], parts[~active])
                rows, parts, ranks, best, lowest = rows[active], parts[active], ranks[active], best[active], lowest[active]
                if not len(rows):
                    return out
            width -= 1
            every, spot = np.arange(len(rows)), best[:, None]
            parts = np.where(np.arange(width) <= spot, parts[:, :-1], parts[:, 1:])
            parts[every, best] = self.merged[lowest]
            ranks = np.where(np.arange(width - 1) < spot, ranks[:, :-1], ranks[:, 1:])
            before, after = best > 0, best < width - 1
            ranks[every[before], best[before] - 1] = self.ranks(parts[every[before], best[before] - 1], parts[every[before], best[before]])
            ranks[every[after], best[after]] = self.ranks(parts[every[after], best[after]], parts[every[after], best[after] + 1])
        finish(rows, parts)
        return out

    def _merge_long(self, word: bytes) -> bytes:
        """Ids of one long word: the same merges in the same order, smallest rank and then leftmost first, from a heap."""
        parts = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        first = self.ranks(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r < _NONE]
        heapq.heapify(heap)
        rank_of = lambda a, b: int(self.ranks(np.array([a]), np.array([b]))[0])
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else len(parts)
            if j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m < len(parts) and (r := rank_of(parts[k], parts[m])) < _NONE:
                    heapq.heappush(heap, (r, k, parts[k], parts[m]))
        return np.array([p for p in parts if p >= 0], np.int32).tobytes()

    def _learn(self, words: Iterable[str]) -> None:
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            if len(data) > SHORT_WORD:
                self.words[word] = self._merge_long(data)
            else:
                by_length.setdefault(len(data), []).append((word, data))
        for group in by_length.values():
            ids = self._merge_equal_lengths([d for _, d in group])
            self.words.update(zip((w for w, _ in group), ids, strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """int32 ids of each text, as the ``tokenizers`` library gives them without special tokens added."""
        pieces = []
        for text in texts:
            if not text:
                pieces.append([])
            elif self.added_split is None or not any(t in text for t in self.added):
                pieces.append(self.split(text))
            else:
                # every second part is an added token, kept apart from words as a tuple
                cut = self.added_split.split(text)
                pieces.append([w for k, part in enumerate(cut) for w in ([(part,)] if k % 2 else self.split(part))])
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        known = self.words
        for token, i in self.added.items():
            known[(token,)] = np.array([i], np.int32).tobytes()
        missing = {w for words in pieces for w in words if w not in known}
        self._learn(missing)
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in pieces]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id and the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, text):
            ids = bpe.encode_batch(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _id_lists(ids)], names=["doc_id", "ids"])
        bpe.words.clear()
        tidy()

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that each row's ids stand for, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            lists = batch.column("ids")
            texts = [bpe.decode(x.values.to_numpy()) if x.is_valid else "" for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, ids and the text decoded from these ids, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, text):
            ids = bpe.encode_batch(batch.column(text).to_pylist())
            decoded = pa.array([bpe.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _id_lists(ids), decoded], names=["doc_id", "ids", "decoded"])
        bpe.words.clear()
        tidy()

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
