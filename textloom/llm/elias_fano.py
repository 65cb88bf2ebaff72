"""Elias-Fano sequences in numpy: compact monotone integers that answer many queries at once from mapped memory.

A value's low bits are packed, its high bits are a unary bit vector; one running count of ones per 64-bit word
serves both selects. All queries take arrays.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

U = np.uint64
_ONES, _TOPS = U(0x0101010101010101), U(0x8080808080808080)
#: Position of the r-th set bit of a byte, at [r * 256 + byte].
_IN_BYTE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for r in range(8) for b in range(256)], np.int64)


def _in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the rank-th (from 0) set bit of each word: the byte by sums of bytes, then the bit by table."""
    sums = word - ((word >> U(1)) & U(0x5555555555555555))
    sums = (sums & U(0x3333333333333333)) + ((sums >> U(2)) & U(0x3333333333333333))
    sums = ((sums + (sums >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _ONES
    rank = rank.astype(U)
    place = np.bitwise_count((((rank * _ONES) | _TOPS) - sums) & _TOPS).astype(U) << U(3)
    place = np.minimum(place, U(56))
    before = ((sums << U(8)) >> place) & U(255)
    byte = (word >> place) & U(255)
    return place.astype(np.int64) + _IN_BYTE[(((rank - before) & U(7)) << U(8) | byte).astype(np.int64)]


class EliasFano:
    """A sequence of non-decreasing integers below ``universe``; ``arrays`` holds its parts, to be stored or mapped."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.n, self.low_bits = (int(x) for x in arrays["meta"])
        self.low, self.high, self.before = arrays["low"], arrays["high"], arrays["before"]

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(U)
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (values >> U(low_bits)).astype(np.int64) if low_bits < 64 else np.zeros(n, np.int64)
        length = n + int((universe - 1 if universe else 0) >> low_bits) + 2
        bits = np.zeros(-(-length // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
        packed = np.zeros(n * low_bits // 64 + 2, U)
        if low_bits and n:
            lows = values & U((1 << low_bits) - 1)
            start = np.arange(n, dtype=np.int64) * low_bits
            word, shift = start >> 6, (start & 63).astype(U)
            # Words are filled in order, so each one's parts are neighbours.
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            packed[word[first]] = np.bitwise_or.reduceat(lows << shift, first)
            spill = np.flatnonzero((start & 63) + low_bits > 64)
            packed[word[spill] + 1] |= lows[spill] >> (U(64) - shift[spill])
        return cls({"meta": np.array([n, low_bits], np.int64), "low": packed, "high": words, "before": before})

    @cached_property
    def zeros_before(self) -> np.ndarray:
        return np.arange(len(self.before), dtype=np.int64) * 64 - self.before

    def _one(self, rank: np.ndarray) -> np.ndarray:
        """Position of the rank-th one of the high bits."""
        at = np.searchsorted(self.before, rank, side="right") - 1
        return at * 64 + _in_word(self.high[at], rank - self.before[at])

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.zeros_before, rank, side="right") - 1
        return at * 64 + _in_word(~self.high[at], rank - self.zeros_before[at])

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), U)
        start = index * self.low_bits
        word, shift = start >> 6, (start & 63).astype(U)
        value = self.low[word] >> shift
        more = self.low[word + 1] << ((U(64) - shift) & U(63))
        value = np.where((start & 63) + self.low_bits > 64, value | more, value)
        return value & U((1 << self.low_bits) - 1)

    def access(self, index: np.ndarray) -> np.ndarray:
        index = np.asarray(index, np.int64)
        if not len(index):
            return np.empty(0, U)
        high = (self._one(index) - index).astype(U)
        return (high << U(self.low_bits)) | self._low(index)

    def pair(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at index and index + 1: the second one's high bit mostly stands in the same word."""
        index = np.asarray(index, np.int64)
        if not len(index):
            return np.empty(0, U), np.empty(0, U)
        one = self._one(index)
        word = one >> 6
        # Shifting twice also clears the bit itself where it is the word's last.
        rest = (self.high[word] >> (one & 63).astype(U)) >> U(1)
        after = one + 1 + np.bitwise_count((rest & (~rest + U(1))) - U(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        if len(far):
            after[far] = self._one(index[far] + 1)
        values = ((p - i).astype(U) << U(self.low_bits) | self._low(i) for p, i in ((one, index), (after, index + 1)))
        return tuple(values)

    def successor(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first index in [lo, hi) whose value is at least ``value``, else hi."""
        value = np.asarray(value, U)
        if not len(value) or not self.n:
            return np.minimum(np.asarray(lo, np.int64), hi)
        high = (value >> U(self.low_bits)).astype(np.int64)
        top = int(len(self.high) * 64 - self.n) - 1
        inside = high <= top
        safe = np.minimum(high, top)
        begin = np.where(safe > 0, self._zero(np.maximum(safe - 1, 0)) - (safe - 1), 0)
        stop = self._zero(safe) - safe
        begin, stop = np.where(inside, begin, self.n), np.where(inside, stop, self.n)
        a, b = np.clip(begin, lo, hi), np.clip(stop, lo, hi)
        want = value & U((1 << self.low_bits) - 1)
        while True:  # the low bits of one high part are sorted
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < want[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
