"""Vectorised splitting and hashing of the words of whole texts, shared by the operators on text.

A batch of texts is one array of UTF-8 bytes with offsets, as Arrow lays it out; no Python
object is made for a word. A word is a run of bytes other than 0x20 and 0x09-0x0D. Its 64-bit
hash is a polynomial over random byte values, taken from prefix sums, and then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Texts are worked on in slices of about so many bytes; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20
_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_random = np.random.RandomState(20240229)
BYTES = _random.randint(0, 2**32, 256).astype(U) << U(32) | _random.randint(0, 2**32, 256).astype(U)
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or have[0].size < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 2**64), U)
        up[0] = down[0] = 1
        have = _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have[0][:n], have[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of values[start:stop] for each span; equal spans get equal hashes anywhere."""
    up, down = powers(base, values.size + 1)
    total = np.empty(values.size + 1, U)
    total[0] = 0
    np.cumsum(values * up[: values.size], out=total[1:])
    return mixed((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(U) * U(0x2545F4914F6CDD1D))


class Slice:
    """Some texts of a batch: .data bytes, .off offsets (a text is data[off[i]:off[i+1]]), .at first row."""

    def __init__(self, data: np.ndarray, off: np.ndarray, at: int):
        self.data, self.off, self.at, self.n = data, off, at, off.size - 1

    def split(self) -> Slice:
        """Sets .starts and .stops of each word and .ptr: text i has the words ptr[i]:ptr[i+1]."""
        solid = ~SPACE[self.data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        at = self.off[:-1][self.off[:-1] < self.data.size]
        first[at] = solid[at]
        to = self.off[1:][self.off[1:] > 0] - 1
        last[to] = solid[to]
        self.solid, self.starts, self.stops = solid, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.starts, self.off)
        return self

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A hash of each word; fold lower-cases A-Z."""
        return spans_hash((FOLDED if fold else BYTES)[self.data], self.starts, self.stops)

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.ptr))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.stops[i]].tobytes()


def windows(hashes: np.ndarray, ptr: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position of the first word, text) of each run of width words inside one text."""
    counts = np.maximum(np.diff(ptr) - width + 1, 0)
    docs = np.repeat(np.arange(counts.size), counts)
    at = np.arange(docs.size) - np.repeat(np.cumsum(counts) - counts, counts) + ptr[docs] if docs.size else np.zeros(0, np.int64)
    return spans_hash(hashes, at, at + width, _WINDOW_BASE), at, docs


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string or binary column; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@cache
def _trimmer():
    """malloc_trim of the C library, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def trim() -> None:
    """Gives freed memory back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    _trimmer()(0)


def slices(array: pa.Array, size: int | None = None) -> Iterator[Slice]:
    """The rows of a column in order, in slices of about size bytes."""
    data, off = column(array)
    size, i, n = size or SLICE_BYTES, 0, off.size - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1))
        yield Slice(data[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j
    trim()


def sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The sum of values[ptr[i]:ptr[i+1]] for each i; empty ranges give 0."""
    total = np.zeros(values.size + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in the sorted table, and whether it is there."""
    if not table.size:
        return np.zeros(keys.size, np.int64), np.zeros(keys.size, bool)
    at = np.minimum(np.searchsorted(table, keys), table.size - 1)
    return at, table[at] == keys


class Memo:
    """Rows of numbers by 64-bit key, for values that are dear to compute; dropped when full.

    compute(indices) returns the rows of the missing keys. Forgetting changes no result. New rows
    first go to a small table, so that the large one is seldom rewritten.
    """

    def __init__(self, columns: int, limit: int = 400_000, dtype=np.int64):
        self.limit, self.columns, self.dtype = limit, columns, dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, U), np.zeros((0, self.columns), self.dtype)
        self.new_keys, self.new_rows = self.keys, self.rows

    def get(self, keys: np.ndarray, compute) -> np.ndarray:
        """keys: distinct and sorted."""
        out = np.empty((keys.size, self.columns), self.dtype)
        missing = np.arange(keys.size)
        for table, rows in ((self.keys, self.rows), (self.new_keys, self.new_rows)):
            at, known = found(table, keys[missing])
            out[missing[known]] = rows[at[known]]
            missing = missing[~known]
        if missing.size:
            out[missing] = compute(missing)
            if self.keys.size + self.new_keys.size + missing.size > self.limit:
                self.clear()
            into = np.searchsorted(self.new_keys, keys[missing])
            self.new_keys = np.insert(self.new_keys, into, keys[missing])
            self.new_rows = np.insert(self.new_rows, into, out[missing], axis=0)
            if 8 * self.new_keys.size > self.keys.size:
                into = np.searchsorted(self.keys, self.new_keys)
                self.keys = np.insert(self.keys, into, self.new_keys)
                self.rows = np.insert(self.rows, into, self.new_rows, axis=0)
                self.new_keys, self.new_rows = self.new_keys[:0], self.new_rows[:0]
        return out


def texts(rows: Slice, first: np.ndarray) -> list[str]:
    """The words with these numbers as strings."""
    raw = rows.data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(rows.starts[first].tolist(), rows.stops[first].tolist())]
