"""Words of Arrow text columns as numpy arrays: a byte pass, no Python object per word.

A word is a maximal run of bytes other than the space and 0x09-0x0D; A-Z are
lowered. Its key is a 64-bit polynomial hash of the lowered bytes, so equal
words have equal keys in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > SLICE_BYTES + 64:
        return _power(_BASE, n), _power(_INVERSE, n)
    if not _powers or len(_powers["up"]) < n:
        size = min(max(n, 1 << n.bit_length()), SLICE_BYTES + 64)
        _powers["up"] = _power(_BASE, size)
        _powers["down"] = _power(_INVERSE, size)
    return _powers["up"][:n], _powers["down"][:n]


def _power(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of the rows first .. first + rows of a column."""

    first: int
    rows: int
    data: np.ndarray  # lowered bytes of the slice
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # the row of each word, from 0 in the slice
    key: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    @property
    def bounds(self) -> np.ndarray:
        """The first word of each row, and the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a column, some whole rows of about `size` bytes at a time."""
    data, offsets = raw(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield _words(LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first], first)
        first = last


def _words(data: np.ndarray, offsets: np.ndarray, first: int) -> Words:
    n = len(data)
    solid = ~SPACE[data]
    opens = np.zeros(n + 1, dtype=bool)  # where a row begins or ends, a word cannot go on
    opens[offsets] = True
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], before[1:] = False, solid[:-1]
        after[-1], after[:-1] = False, solid[1:]
    start = np.flatnonzero(solid & (~before | opens[:-1]))
    end = np.flatnonzero(solid & (~after | opens[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    up, down = powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64, out=total[1:])
    key = mix((total[end] - total[start]) * (down[start] if n else total[:0]))
    return Words(first, len(offsets) - 1, data, start, end, row, key)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the word n-grams of each row, and the bounds of the rows.

    A row of fewer words than the width has one shingle of all its words, a row
    without words has none.
    """
    bounds = words.bounds
    count = np.diff(bounds)
    key, n = words.key, len(words.key)
    at = np.arange(n)
    left = bounds[1:][words.row] - at  # words from here to the end of the row
    gram = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        inside = left > i
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[: max(n - i, 0)] = key[i:]
        gram = np.where(inside, mix(gram * np.uint64(31) + shifted + np.uint64(i + 1)), gram)
    whole = (left >= width) | ((at == bounds[:-1][words.row]) & (count[words.row] < width))
    gram, row = gram[whole], words.row[whole]
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    if len(gram):
        fresh = np.r_[True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])]
        gram, row = gram[fresh], row[fresh]
    return gram, np.searchsorted(row, np.arange(words.rows + 1))
