"""Elias-Fano coded monotone sequences in memory-mapped buffers, searched for many values at once."""

from __future__ import annotations

import tempfile

import numpy as np

_SELECT_ROWS = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_NTH = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.int64)  # place of the n-th one of a byte, from 0


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one, from 1, of each word of 64 bits."""
    split = words.view(np.uint8).reshape(-1, 8)
    ones = np.cumsum(np.bitwise_count(split), axis=1, dtype=np.uint8)
    byte, row = (ones >= k[:, None]).argmax(axis=1), np.arange(len(words))
    split = split[row, byte]
    return byte * 8 + _NTH[split, k - ones[row, byte] + np.bitwise_count(split) - 1]


def mapped(array: np.ndarray) -> np.ndarray:
    """The array in an unnamed memory-mapped file; gone with its last user."""
    if not array.size:
        return array
    with tempfile.TemporaryFile() as f:
        out = np.memmap(f, array.dtype, "w+", shape=array.shape)
    out[:] = array
    return out


class EliasFano:
    """``values``: ascending unsigned numbers. Low bits are packed side by side, high bits are unary gaps."""

    def __init__(self, values: np.ndarray) -> None:
        values = values.astype(np.uint64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.highs = int(high[-1]) + 1 if n else 0
        bits = np.zeros(n + self.highs + 64, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits[: len(bits) // 64 * 64], bitorder="little")
        ones = np.add.reduceat(np.unpackbits(packed, bitorder="little"), np.arange(0, len(packed) * 8, 64), dtype=np.int64)
        self.upper = mapped(packed)
        self.zeros = np.concatenate([[0], np.cumsum(64 - ones)])  # before each word of 64 bits
        if self.low_bits:
            low = values & np.uint64((1 << self.low_bits) - 1)
            words = np.zeros(n * self.low_bits // 64 + 2, np.uint64)
            at = np.arange(n, dtype=np.uint64) * np.uint64(self.low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(words, word, low << shift)
            over = shift + np.uint64(self.low_bits) > np.uint64(64)
            np.bitwise_or.at(words, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
            self.lower = mapped(words)

    def nbytes(self) -> int:
        return self.upper.nbytes + (self.lower.nbytes if self.low_bits else 0)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.lower[word] >> shift
        more = shift + np.uint64(self.low_bits) > np.uint64(64)
        out[more] |= self.lower[word[more] + 1] << (np.uint64(64) - shift[more])
        return out & np.uint64((1 << self.low_bits) - 1)

    def _start(self, high: np.ndarray) -> np.ndarray:
        """Index of the first value whose high part is ``high`` or more: the ones before the high-th zero."""
        out = np.zeros(len(high), np.int64)
        asked = np.flatnonzero(high > 0)
        words = np.asarray(self.upper).view(np.uint64)
        for a in range(0, len(asked), _SELECT_ROWS):
            i = asked[a : a + _SELECT_ROWS]
            k = high[i]  # the k-th zero, from 1
            word = np.searchsorted(self.zeros, k, "left") - 1
            out[i] = word * 64 + _select(~words[word], k - self.zeros[word]) + 1 - k
        return out

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        out = np.zeros(len(i), np.int64)
        words = np.asarray(self.upper).view(np.uint64)
        ones = np.arange(len(self.zeros)) * 64 - self.zeros  # before each word of 64 bits
        for a in range(0, len(i), _SELECT_ROWS):
            k = i[a : a + _SELECT_ROWS] + 1  # the k-th one, from 1
            word = np.searchsorted(ones, k, "left") - 1
            out[a : a + _SELECT_ROWS] = word * 64 + _select(words[word], k - ones[word]) + 1 - k
        return (out << self.low_bits) | self._low(i).astype(np.int64)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value that is ``x`` or more, and whether it equals ``x``."""
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.low_bits))
        past = high >= np.uint64(self.highs)
        high = np.minimum(high, np.uint64(max(self.highs - 1, 0))).astype(np.int64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        start, end = self._start(high), self._start(high + 1)
        want = x & np.uint64((1 << self.low_bits) - 1)
        low, top = start.copy(), end.copy()
        while (low < top).any():
            mid = (low + top) // 2
            less = self._low(np.minimum(mid, self.n - 1)) < want
            go = low < top
            low, top = np.where(go & less, mid + 1, low), np.where(go & ~less, mid, top)
        same = (low < end) & (self._low(np.minimum(low, self.n - 1)) == want) & ~past
        return np.where(past, self.n, low), same
