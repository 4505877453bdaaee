"""Numpy helpers for repeated substrings: q-gram names, block cuts, bucket-pointer refinement."""

from __future__ import annotations

import numpy as np

#: Bytes of an initial q-gram; three refinements at the length so far make the length below.
Q = 50
#: Length in bytes of the strings that count as repeated.
LENGTH = 400
#: String starts of a text that are worked on at once; offsets within a segment fit 20 bits.
SEGMENT = (1 << 20) - 512
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the bases and of their inverses, as long as has been needed so far."""

    def __init__(self) -> None:
        self.up: list[np.ndarray] = []
        self.down: list[np.ndarray] = []

    def get(self, n: int) -> None:
        if not self.up or len(self.up[0]) < n:
            n = 1 << max(14, (n - 1).bit_length())
            self.up = [_powers(b, n) for b in _BASES]
            self.down = [_powers(pow(b, -1, 1 << 64), n) for b in _BASES]


_TABLES = _Tables()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def qgram_names(data: np.ndarray, lane: int, q: int = Q) -> np.ndarray:
    """A 64-bit name of the q-gram at every offset: equal q-grams have equal names anywhere."""
    n = len(data)
    _TABLES.get(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(data * _TABLES.up[lane][:n], out=sums[1:])
    return mix((sums[q:] - sums[:-q]) * _TABLES.down[lane][: n - q + 1])


def sliding_choice(names: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` names the offset of its smallest, the leftmost on ties.

    Only the upper 44 bits count; the lower ones carry the offset.
    """
    keyed = (names & _U(0xFFFFFFFFFFF00000)) | np.arange(len(names), dtype=_U)
    rows = -(-len(keyed) // width)
    grid = np.full(rows * width, _U(0xFFFFFFFFFFFFFFFF))
    grid[: len(keyed)] = keyed
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = len(names) - width + 1
    return (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & _U(0xFFFFF)).astype(np.int64)


def cut_blocks(data: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first, last, anchor): blocks of string starts that choose the same q-gram, for a segment's bytes or word names.

    A string of ``length`` bytes chooses one q-gram inside it (its anchor) by
    content alone, so equal strings lie in blocks with the same bucket name and
    at the same distance from the anchor.
    """
    names = qgram_names(data, 0, q)
    chosen = sliding_choice(names, length - q + 1)
    cuts = np.flatnonzero(np.diff(chosen)) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts, [len(chosen)]]) - 1
    return names[chosen[first]], first, last, chosen[first]


def _runs(values: np.ndarray) -> np.ndarray:
    """For sorted values the place where each one's run of equal values starts."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def _initial_buckets(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the q-grams at the places ``at``: a bucket's identifier is its place in sorted order.

    Buckets are sorted by name, and each member's bytes are held against its neighbour's.
    """
    names = qgram_names(data, 0)[at]
    order = np.argsort(names)
    starts = _runs(names[order])
    same = np.flatnonzero(starts[1:] == starts[:-1])
    one, two = at[order[same]], at[order[same + 1]]
    words = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(np.uint64)[:, 0] if len(data) >= 8 else np.empty(0, np.uint64)
    if not all((words[one + k] == words[two + k]).all() for k in (*range(0, Q - 8, 8), Q - 8)):  # two q-grams with one name: sort the bytes themselves
        grams = np.lib.stride_tricks.sliding_window_view(data, Q)[at].copy().view(f"V{Q}")[:, 0]
        order = np.argsort(grams, kind="stable")
        starts = _runs(np.unique(grams, return_inverse=True)[1][order])
    out = np.empty(len(at), np.int64)
    out[order] = starts
    return out


def repeated_strings(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the ``LENGTH``-byte strings that start more than once in pieces of these sizes, laid end to end.

    Bucket-pointer refinement: suffixes start in buckets by q-gram.  A round
    sorts every crowded bucket on the bucket identifiers of the suffixes so
    many bytes further on as the buckets are deep, splits it where they differ,
    and writes the refined identifiers back, so the next round reads them at
    twice the depth.  Suffixes alone in their bucket, or too near their piece's
    end, drop out.
    """
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    pointers = np.full(len(data), -1, np.int64)
    at, depth = np.flatnonzero(room >= Q), Q
    if not len(at):
        return at
    pointers[at] = _initial_buckets(data, at)
    while depth < LENGTH:
        members = np.bincount(pointers[at], minlength=len(data))
        at = at[(members[pointers[at]] > 1) & (room[at] >= 2 * depth)]
        own, further = pointers[at], pointers[at + depth]
        order = np.argsort((own.astype(_U) << _U(32)) | further.astype(_U))
        own, further = own[order], further[order]
        buckets = _runs(own)
        split = np.ones(len(own), bool)
        split[1:] = (own[1:] != own[:-1]) | (further[1:] != further[:-1])
        pointers[at[order]] = own + np.maximum.accumulate(np.where(split, np.arange(len(own)), 0)) - buckets if len(own) else own
        depth *= 2
    members = np.bincount(pointers[at], minlength=len(data))
    return at[members[pointers[at]] > 1]
