"""Whole-text kernels over Arrow buffers: texts stay bytes and words stay offsets, no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are worked on at once; one longer text is worked on alone, never cut.
CHUNK_BYTES = 1 << 20
#: The odd multiplier of polynomial hashes modulo 2^64, and its inverse there.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: x20 and x09-x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32
#: All but ASCII letters, ASCII digits and the bytes of characters beyond ASCII.
NOT_WORD = np.ones(256, bool)
NOT_WORD[0x80:] = False
for _first, _last in ("09", "AZ", "az"):
    NOT_WORD[ord(_first): ord(_last) + 1] = False


def utf8(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if lower:
        column = pc.utf8_lower(column.cast(pa.large_string()))
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, last = (int(ends[0]), int(ends[-1])) if len(ends) else (0, 0)
    return whole[first:last], ends - first


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, min(n, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield at, to, data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at]
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that are no separators; no word crosses rows."""
    gap = separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~gap
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = gap[1:]
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class Polynomial:
    """Hashes of any byte ranges of one buffer from a prefix sum: C[i] = sum of (byte + 1) * B^j below i, modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._down = _powers(_BASE_INV, n + 1)
        self._sums = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * _powers(_BASE, n), out=self._sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k bytes from each place on."""
        n = len(self._sums) - k
        return mix((self._sums[k:] - self._sums[:-k]) * self._down[:n])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])


_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _kept or len(_kept[base]) < n:
        out = np.full(max(n, CHUNK_BYTES + 1024), base, U64)
        out[0] = 1
        if n > CHUNK_BYTES + 1024:
            return np.multiply.accumulate(out)
        _kept[base] = np.multiply.accumulate(out)
    return _kept[base][:n]


def word_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
