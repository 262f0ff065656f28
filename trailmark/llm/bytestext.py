"""Whole batches of texts as byte arrays: words and their hashes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PART_BYTES = 2 << 20  # texts handled at once; a longer text is handled alone
BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets between them; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(column: pa.Array, size: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``size`` bytes."""
    data, offsets = text_bytes(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; bytes of other characters are never in that range."""
    return _LOWER[data]


def mix64(x: np.ndarray) -> np.ndarray:
    """One-to-one mixing of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 .. n-1."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers[:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each blank-separated word and the row it is in."""
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after = np.empty(len(data), bool)
    if len(data):
        after[0] = True
        after[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (after | edge[:-1]))
    before = np.empty(len(data), bool)
    if len(data):
        before[-1] = True
        before[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (before | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = (data[np.repeat(starts, lengths) + inside].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[inside]
    return mix64(np.add.reduceat(value, first))
