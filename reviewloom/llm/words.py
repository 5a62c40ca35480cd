"""Vectorised words and hashes of Arrow text columns, for use inside Spark tasks.

Words are maximal runs of bytes outside space and \\t..\\r. The hash of a word of LONG bytes at most is a polynomial over
random byte values modulo 2^64, taken from prefix sums, so a whole batch is hashed with a few array operations and no
Python per word. Such sums lose bits on long self-similar strings, whatever the base (two complementary Thue-Morse
strings of 1024 bytes collide), so longer words, which are few, are hashed by BLAKE2.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18  # bytes hashed at once
LONG = 32  # bytes; longer spans are hashed one by one
BATCH_BYTES = 2 << 20  # text bytes that one step of a task works on
_POWER = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_U = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim.restype = ctypes.c_int
except (OSError, AttributeError):  # another C library: its allocator decides
    _LIBC = None


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_POWER, BLOCK)
_INV = _powers(pow(_POWER, -1, 1 << 64), BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its start and of its next item; order matters."""
    return mix(left * _U(0xD6E8FEB86659FD93) + right)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `limit` bytes of text; one row is never cut."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)
    release()


def release() -> None:
    """Gives memory that is free in this worker back to the system, as workers live as long as their executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


_KEPT: dict = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a worker keeps between tasks: one thing at a time, made anew when another operator has run in between."""
    if key not in _KEPT:
        _KEPT.clear()
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows in one array, and where each row starts and the last ends. Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a text column: byte positions, hash, and how many each row has."""

    def __init__(self, column: pa.Array, fold: bool = True):
        raw, self.rows = utf8(column)
        self.data = _FOLD[raw] if fold else raw
        n = len(self.data)
        space = _IS_SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.rows] = True
        first, last = ~space, ~space
        first[1:] &= space[:-1] | edge[1:n]
        last[:-1] &= space[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.rows)  # index of each row's first word, and the end
        self.count = np.diff(self.first)
        self.hash = span_hashes(self.data, self.start, self.end)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def digests(self) -> list[bytes]:
        """16 bytes for each row: a digest of its words' bytes with one blank between them."""
        space = _IS_SPACE[self.data]
        edge = np.zeros(len(space) + 1, bool)
        edge[self.rows] = True
        held = ~space
        held[1:] |= ~space[:-1] & ~edge[1 : len(space)]  # the first blank after a word
        packed = np.where(space, np.uint8(32), self.data)[held]
        at = np.concatenate([[0], np.cumsum(held)])[self.rows].tolist()
        return [blake2b(packed[a:b].tobytes().rstrip(b" "), digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end]. Spans must be ordered by start and by end; none is empty."""
    out = np.empty(len(start), np.uint64)
    long = end - start > LONG
    for i in np.flatnonzero(long).tolist():
        out[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(~long)
    begin, stop = start[short], end[short]
    i = 0
    while i < len(short):
        at = begin[i]
        j = int(np.searchsorted(stop, at + BLOCK, "right"))
        part = data[at : stop[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * _POW[: len(part)], out=sums[1:])
        a, b = begin[i:j] - at, stop[i:j] - at
        out[short[i:j]] = mix((sums[b] - sums[a]) * _INV[a] + (b - a).astype(np.uint64))
        i = j
    return out


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and how many each row has; a row with fewer words, but not none, is one run."""
    h, count = words.hash, words.count
    many = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    first = np.repeat(words.first[:-1], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    length = np.repeat(np.minimum(count, n), many)
    out = h[first] if len(first) else np.zeros(0, np.uint64)
    for k in range(1, n):
        more = k < length
        out[more] = chain(out[more], h[first[more] + k])
    return mix(out + length.astype(np.uint64)), many


def hash_column(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


class Memo:
    """Values by 64-bit key in sorted arrays. Call room() before a batch is looked up, never between find() and learn():
    it starts the memo anew beyond `limit` entries, so that what find() called known is still there afterwards."""

    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, known); a value means something only where it is known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at], self.keys[at] == keys

    def room(self) -> None:
        if len(self.keys) > self.limit:
            self.__init__(self.limit)

    def learn(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys, values = np.concatenate([self.keys, keys]), np.concatenate([self.values, values])
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]


def totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values; first: index of each row's first value, and the end."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def maxima(values: np.ndarray, first: np.ndarray, empty: int = 0) -> np.ndarray:
    """Largest of each row's values; `empty` for a row that has none."""
    out = np.full(len(first) - 1, empty, np.int64)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = np.maximum.reduceat(values, first[:-1][full])
    return out
