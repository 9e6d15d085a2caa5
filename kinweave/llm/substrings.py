"""Hashes of all substrings of a length, and their minimizers, for one text at a time."""

from __future__ import annotations

import numpy as np

_FACTOR = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2^64
_powers = np.ones((2, 1), np.uint64)


def _bytes_table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 64, 256, dtype=np.uint64)


_TABLE = _bytes_table()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """Powers 0 … n of the factor and of its inverse, modulo 2^64."""
    global _powers
    if _powers.shape[1] <= n:
        base = np.array([[_FACTOR], [pow(_FACTOR, -1, 1 << 64)]], np.uint64)
        steps = np.broadcast_to(base, (2, max(n + 1, 2 * _powers.shape[1]))).copy()
        steps[:, 0] = 1
        _powers = np.multiply.accumulate(steps, axis=1)
    return _powers


class Hashed:
    """A text's bytes with hashes of any of its substrings."""

    def __init__(self, data: bytes):
        self.n = len(data)
        self.up, self.down = powers(self.n)
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * self.up[: self.n], out=sums[1:])
        self.sums = sums

    def at(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[starts + length] - self.sums[starts]) * self.down[starts])

    def all(self, length: int) -> np.ndarray:
        """Hashes of the substrings of a length at 0, 1, …"""
        k = self.n - length + 1
        return mix((self.sums[length:] - self.sums[:k]) * self.down[:k])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of a width, by prefix and suffix minima of blocks of that width."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    b = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    behind = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(h: Hashed, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(at, lo, hi, gram hash) of each anchor of a text of at least `length` bytes.

    A window of `length` bytes has as its anchor the gram in it with the smallest hash, the first of
    equals; that depends on the window's bytes alone. The windows lo … hi have the one at `at` in common.
    """
    order = h.all(gram)
    shift = np.uint64(max(1, len(order).bit_length()))
    keyed = (order >> shift << shift) | np.arange(len(order), dtype=np.uint64)
    where = (sliding_minimum(keyed, length - gram + 1) & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    lo = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    return where[lo], lo, np.r_[lo[1:], len(where)] - 1, order[where[lo]].view(np.int64)
