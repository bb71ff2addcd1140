"""Elias-Fano sequences: sorted numbers in about 2 + log2(universe / count) bits each, searched and read in place.

The low bits of each number are packed; the high bits are a bit vector in which each number sets one bit and each step to the
next high value clears one. Everything is an array that can be memory-mapped; lookups are batches, in numpy.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

_U = np.uint64
_EACH, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Where the k-th set bit of a byte stands, at k * 256 + byte.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8) for b in range(256)], np.int64)


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where the k-th (from 0) set bit of each word stands: its byte by running sums over the bytes, then its place in the byte."""
    k = k.astype(np.uint64)
    sums = word - ((word >> _U(1)) & _U(0x5555555555555555))
    sums = (sums & _U(0x3333333333333333)) + ((sums >> _U(2)) & _U(0x3333333333333333))
    sums = ((sums + (sums >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH
    byte = np.bitwise_count(((k * _EACH) | _TOPS) - sums & _TOPS).astype(np.uint64) << _U(3)
    k -= ((sums << _U(8)) >> byte) & _U(255)
    return _IN_BYTE[((k << _U(8)) | ((word >> byte) & _U(255))).astype(np.int64)] + byte.astype(np.int64)


def _bits(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """57 bits or more from each place in bytes, eight of which follow any place asked for."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return words[at >> 3] >> (at & 7).astype(np.uint64)


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Numbers of `width` bits one after the other; eight spare bytes at the end, so that a read of eight never leaves."""
    out = np.zeros((len(low) * width + 7) // 8 + 8, np.uint8)
    for a in range(0, len(low), 1 << 15):
        bits = np.unpackbits(low[a:a + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        part = np.packbits(bits.reshape(-1), bitorder="little")
        out[a * width // 8:a * width // 8 + len(part)] = part
    return out


class EliasFano:
    """arrays: n and width (one array), low (bytes), high (64-bit words), rank (set bits before each word)."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in arrays["shape"])
        self.low, self.high, self.rank = arrays["low"], arrays["high"], arrays["rank"]

    @cached_property
    def zeros(self) -> np.ndarray:
        """Clear bits before each word."""
        return np.arange(len(self.high), dtype=np.int64) * 64 - self.rank.astype(np.int64)

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        """values: sorted uint64, fewer than 2**32, below universe (at most 2**63)."""
        n = len(values)
        if n >> 32 or universe > 1 << 63:
            raise ValueError(f"{n} numbers below {universe} are too many")
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        top = (max(1, universe) - 1) >> width
        bits = np.zeros((n + top + 1 + 63) // 64 * 64 + 64, np.uint8)
        bits[(values >> _U(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        rank = np.concatenate(([0], np.cumsum(np.bitwise_count(high))[:-1])).astype(np.uint32)
        return {"shape": np.array([n, width], np.int64), "low": _pack(values & _U((1 << width) - 1), width), "high": high, "rank": rank}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        return _bits(self.low, i * self.width) & _U((1 << self.width) - 1)

    def _one(self, i: np.ndarray) -> np.ndarray:
        """Where the i-th set bit stands."""
        j = np.searchsorted(self.rank, i.astype(np.uint32), "right") - 1
        return j * 64 + _select(self.high[j], i - self.rank[j])

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th clear bit stands."""
        j = np.searchsorted(self.zeros, k, "right") - 1
        return j * 64 + _select(~self.high[j], k - self.zeros[j])

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        return ((self._one(i) - i).astype(np.uint64) << _U(self.width)) | self._low(i)

    def step(self, i: np.ndarray) -> np.ndarray:
        """By how much the numbers at places i + 1 exceed those at i: the clear bits up to the next set one, and the low bits."""
        rest = _bits(self.high.view(np.uint8), self._one(i) + 1)
        up = np.bitwise_count((rest & (~rest + _U(1))) - _U(1)).astype(np.uint64)
        out = (up << _U(self.width)) + self._low(i + 1) - self._low(i)
        far = np.flatnonzero(up > 56)
        if len(far):
            out[far] = self.get(i[far] + 1) - self.get(i[far])
        return out

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the numbers with high part h begin and end: the set bits that follow the clear bit before them."""
        h = h.astype(np.int64)
        start = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) + 1, 0)
        ones = _bits(self.high.view(np.uint8), start)
        n = np.bitwise_count(ones & ~(ones + _U(1))).astype(np.int64)
        lo = start - h
        hi = lo + n
        far = np.flatnonzero(n > 56)
        if len(far):
            hi[far] = self._zero(h[far]) - h[far]
        return lo, hi

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each x the place of the first number that isn't less, where its bucket ends, and its low part: halving in the bucket."""
        lo, hi = self._bucket(x >> _U(self.width))
        want = x & _U((1 << self.width) - 1)
        open_ = np.flatnonzero(lo < hi)
        a, z, low = lo[open_], hi[open_], want[open_]
        while len(open_):
            mid = (a + z) >> 1
            less = self._low(mid) < low
            a, z = np.where(less, mid + 1, a), np.where(less, z, mid)
            lo[open_] = a
            go = np.flatnonzero(a < z)
            open_, a, z, low = open_[go], a[go], z[go], low[go]
        return lo, hi, want

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the place of the first number that isn't less."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, or -1 where it isn't there."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        at, end, want = self._search(x)
        i = np.flatnonzero(at < end)
        i = i[self._low(at[i]) == want[i]]
        out[i] = at[i]
        return out
