"""Rising sequences of whole numbers in Elias-Fano form, over numpy arrays that may be memory-mapped."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers below ``2**bits`` one after another, in 64-bit words with a spare one at the end."""
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.int64) * bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        # What does not fit goes on in the next word.
        out[word[first] + 1] |= np.bitwise_or.reduceat((values >> _ONE) >> (np.uint64(63) - shift), first)
    return out


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``rank`` of each 64-bit word."""
    place = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        up = rank >= below
        rank = rank - np.where(up, below, 0)
        word = np.where(up, word >> np.uint64(width), word)
        place += np.where(up, width, 0)
    return place


class EliasFano:
    """Sorted numbers: low bits packed, high bits as a unary bit vector with ranks by word. ``arrays`` are all its data."""

    def __init__(self, n: int, low_bits: int, arrays: list[np.ndarray]) -> None:
        self.n, self.low_bits, self.arrays = n, low_bits, arrays
        self.low, self.high, self.ones = arrays

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = max(0, ((most + 1) // max(1, n)).bit_length() - 1)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((most >> bits) + n) // 64 * 64 + 64, np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(n, bits, [_pack(values & np.uint64((1 << bits) - 1), bits), high, ones])

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, cut = np.frombuffer(data, np.int64, 3).tolist()
        low, high = np.split(np.frombuffer(data, np.uint64, offset=24), [cut])
        return cls(n, bits, [low, high, np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])])

    def to_bytes(self) -> bytes:
        """The sequence without its ranks."""
        return np.array([self.n, self.low_bits, len(self.low)], np.int64).tobytes() + self.low.tobytes() + self.high.tobytes()

    def values(self) -> np.ndarray:
        """All numbers, in one pass."""
        at = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")) - np.arange(self.n)
        return (at.astype(np.uint64) << np.uint64(self.low_bits) | self._lows(np.arange(self.n))).astype(np.int64)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        return ((self.low[word] >> shift) | ((self.low[word + 1] << _ONE) << (np.uint64(63) - shift))) & np.uint64((1 << self.low_bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the places ``i``; of many, all are decoded in one pass."""
        i = np.asarray(i, np.int64)
        if 8 * len(i) > self.n:
            return self.values()[i]
        word = np.searchsorted(self.ones, i, "right") - 1
        high = word * 64 + _select(self.high[word], i - self.ones[word]) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits) | self._lows(i)).astype(np.int64)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have high bits below ``high``."""
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        wanted = np.minimum(high, zeros[-1]) - 1
        word = np.clip(np.searchsorted(zeros, wanted, "right") - 1, 0, len(self.high) - 1)
        place = word * 64 + _select(~self.high[word], np.maximum(wanted - zeros[word], 0))
        return np.where(wanted < 0, 0, np.minimum(place - wanted, self.n))

    def successor(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first number that is at least ``x``, among the places ``first`` to ``end`` (``end`` if there is none); whether it is ``x``."""
        high, low = x >> self.low_bits, (x & ((1 << self.low_bits) - 1)).astype(np.uint64)
        a, stop = np.clip(self._bucket(high), first, end), np.clip(self._bucket(high + 1), first, end)
        b = stop.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self._lows(middle) < low[open_]
            a[open_] = np.where(less, middle + 1, a[open_])
            b[open_] = np.where(less, b[open_], middle)
            open_ = open_[a[open_] < b[open_]]
        same = a < stop
        same[same] = self._lows(a[same]) == low[same]
        return a, same

    def find(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of ``x`` among the places ``first`` to ``end``, -1 if it is not there."""
        at, same = self.successor(x, first, end)
        return np.where(same, at, -1)
