"""Flat numpy views of batches of texts.

A batch of texts is joined into one code-point array, so that words, hashes and windows of every
text are found with a fixed number of array operations instead of a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
CHUNK_CHARS = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def chunks(lengths: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold about ``limit`` characters each (one text at least)."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n + 1
    if start < len(lengths):
        yield start, len(lengths)


def pieces(column: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of rows of about ``limit`` bytes of text (one row at least), with their texts; null is empty.

    Only one range at a time is turned into Python strings.
    """
    if not len(column):
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, j in chunks(sizes, limit):
        yield i, j, [t or "" for t in column.slice(i, j - i).to_pylist()]


class _Powers:
    """Powers of an odd base and of its inverse mod 2^64, extended on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base = int(base)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * CHUNK_CHARS)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, factor, U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASES]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a line feed after each, and the offset where each text begins (and the end)."""
    joined = "\n".join(texts) + "\n" if texts else ""
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return cps, starts


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the spans of ``values``: equal spans get equal hashes wherever they stand."""
    up, down = _POWERS[which].get(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(mix64(values.astype(U64) + U64(0x1234567 + which)) * up[: len(values)], out=sums[1:])
    return mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch: begin, end (code points) and the first word of each text."""

    def __init__(self, texts: list[str]) -> None:
        self.cps, self.starts = code_points(texts)
        space = (self.cps == 32) | ((self.cps >= 9) & (self.cps <= 13))
        edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
        self.begin = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)  # each text is followed by a line feed
        self.first = np.searchsorted(self.begin, self.starts)

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.cps, self.begin, self.end, which)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring values (runs that cross texts are for the caller to drop)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    base = _BASES[which]
    for j in range(size):
        out *= base
        out += hashes[j : j + n]
    return mix64(out)


def ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes begin[0], begin[0]+1, ... of all ranges, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    offset = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(begin - offset, length)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, rising, where one of each stands (not always the first), and the place of each key among them."""
    order = np.argsort(keys)
    rising = keys[order]
    new = np.append(True, rising[1:] != rising[:-1])[: len(keys)]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return rising[new], order[new], which


class HashIndex:
    """Position of keys in a fixed array of distinct int64 keys: open addressing, probed for many keys at once."""

    def __init__(self, keys: np.ndarray) -> None:
        keys = np.asarray(keys, np.int64)
        bits = max(4, int(8 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.place = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.place[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = np.zeros(len(todo), bool)
            won[first] = True
            won &= free
            self.keys[slot[won]], self.place[slot[won]] = keys[todo[won]], todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * _BASES[0]) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        place = self.place[slot].astype(np.int64)
        miss = np.flatnonzero((place >= 0) & (self.keys[slot] != keys))
        slot = slot[miss]
        while len(miss):
            slot = (slot + 1) & self.mask
            place[miss] = self.place[slot]
            more = (place[miss] >= 0) & (self.keys[slot] != keys[miss])
            miss, slot = miss[more], slot[more]
        return place
