"""Elias-Fano codes of sorted 64-bit numbers in one buffer, which may be a memory-mapped file.

n numbers below u take 2 + log2(u / n) bits each: the low bits packed, the high bits in unary in a bit
vector with a count of ones before every 512 bits. All look-ups work on arrays of queries at once.
"""

from __future__ import annotations

import numpy as np

_WORDS = 8  # of 64 bits in a block of the directory
_ONE = np.uint64(1)
# Where the k-th one of a byte is: row of the byte, column k.
_IN_BYTE = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _ones = [i for i in range(8) if _b >> i & 1]
    _IN_BYTE[_b, : len(_ones)] = _ones


def _skip(counts: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of counts, which count the rest-th item falls into, and which item of that one it is."""
    at, going = np.zeros(len(rest), np.int64), np.ones(len(rest), bool)
    for column in counts.T[:-1]:
        going &= rest >= column
        rest = rest - column * going
        at += going
    return at, rest


def _words(bits: np.ndarray) -> np.ndarray:
    data = np.packbits(bits, bitorder="little")
    return np.pad(data, (0, -len(data) % 8)).view(np.uint64)


def encode(values: np.ndarray, universe: int) -> np.ndarray:
    """Sorted values below universe (at most 2^63) as an array of 64-bit words."""
    v, n = values.astype(np.uint64), len(values)
    low = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
    buckets = (max(universe, 1) >> low) + 1
    upper = np.zeros(-(-(n + buckets + 1) // (64 * _WORDS)) * 64 * _WORDS, bool)
    upper[(v >> np.uint64(low)).astype(np.int64) + np.arange(n)] = True
    upper = _words(upper)
    parts = [np.empty(0, np.uint64)]
    for at in range(0, n if low else 0, 1 << 18):
        piece = v[at : at + (1 << 18), None] >> np.arange(low, dtype=np.uint64) & _ONE
        parts.append(np.packbits(piece.astype(bool).ravel(), bitorder="little"))
    packed = np.concatenate([p.view(np.uint8) for p in parts])
    lower = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
    ones = np.bitwise_count(upper).reshape(-1, _WORDS).sum(axis=1, dtype=np.uint64)
    before = np.r_[np.uint64(0), np.cumsum(ones, dtype=np.uint64)]
    head = np.array([n, universe, low, buckets, len(upper), len(lower)], np.uint64)
    return np.concatenate([head, before, upper, lower])


class Codes:
    """Reads what encode() has made, from any array of 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.n, self.universe, self.low, self.buckets, upper, lower = (int(x) for x in words[:6])
        blocks = upper // _WORDS
        self.before = words[6 : 7 + blocks]
        self.upper = words[7 + blocks : 7 + blocks + upper].reshape(blocks, _WORDS)
        self.flat = words[7 + blocks : 7 + blocks + upper]
        self.lower = words[7 + blocks + upper : 7 + blocks + upper + lower]
        self.words = 7 + blocks + upper + lower
        self.zeros_before = np.arange(blocks + 1, dtype=np.uint64) * np.uint64(64 * _WORDS) - self.before

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th one, or zero, of the upper bits; k counts from 0."""
        before = self.before if ones else self.zeros_before
        k = k.astype(np.uint64)
        block = np.searchsorted(before, k, side="right") - 1
        rest = (k - before[block]).astype(np.int64)
        words = self.upper[block]
        words = words if ones else ~words
        at, rest = _skip(np.bitwise_count(words), rest)
        rows = np.arange(len(k))
        of_word = words[rows, at].view(np.uint8).reshape(-1, 8)
        byte, rest = _skip(np.bitwise_count(of_word), rest)
        return (block * _WORDS + at) * 64 + byte * 8 + _IN_BYTE[of_word[rows, byte], rest]

    def _low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        joined = self.lower[word] >> shift | (self.lower[word + 1] << (np.uint64(63) - shift)) << _ONE
        return joined & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        high = self._select(i, True) - i
        return high.astype(np.uint64) << np.uint64(self.low) | self._low_bits(i)

    def all(self) -> np.ndarray:
        """All numbers, in order."""
        bits = np.unpackbits(np.ascontiguousarray(self.upper).view(np.uint8).ravel(), bitorder="little")
        i = np.arange(self.n)
        high = (np.flatnonzero(bits)[: self.n] - i).astype(np.uint64)
        return high << np.uint64(self.low) | self._low_bits(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first number that is at least x (below the universe); n if there is none."""
        x = x.astype(np.uint64)
        out = np.empty(len(x), np.int64)
        for a in range(0, len(x), 1 << 17):
            out[a : a + (1 << 17)] = self._successor(x[a : a + (1 << 17)])
        return out

    def _begin(self, high: np.ndarray) -> np.ndarray:
        """The place of the first number, if any, whose high bits are `high`."""
        return np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - high + 1, 0)

    def _successor(self, x: np.ndarray) -> np.ndarray:
        high, low = (x >> np.uint64(self.low)).astype(np.int64), x & np.uint64((1 << self.low) - 1)
        at = self._begin(high)
        # Most buckets are short: a few steps along, then by halves for the rest.
        todo = np.arange(len(x))
        for _ in range(4):
            todo = todo[self._inside(at[todo], high[todo]) & (self._low_bits(at[todo]) < low[todo])]
            at[todo] += 1
        start, end = at[todo], self._begin(high[todo] + 1)
        while (open_ := np.flatnonzero(start < end)).size:
            middle = (start[open_] + end[open_]) >> 1
            less = self._low_bits(middle) < low[todo[open_]]
            start[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
        at[todo] = start
        return at

    def _inside(self, at: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the numbers at these places still have these high bits, for places not before their first."""
        bit = (at + high).astype(np.uint64)
        return (self.flat[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & _ONE).astype(bool)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, or -1 where it isn't there."""
        if not self.n:
            return np.full(len(x), -1)
        x = x.astype(np.uint64)
        at = self.successor(x)
        there = self._inside(at, (x >> np.uint64(self.low)).astype(np.int64))
        there[there] = self._low_bits(at[there]) == x[there] & np.uint64((1 << self.low) - 1)
        return np.where(there, at, -1)
