"""The binary Golay code (23, 12, 7) as a fuzzy hash: several 12-bit indices for a 23-bit word.

Every word is within 3 bits of exactly one codeword. A word within 2 bits of its codeword gets that
codeword's index. A word 3 bits off gets it and those of the five codewords 4 bits away. Then any two
words at most 2 bits apart have an index in common (tests/llm/test_simhash.py tries all cases).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
MOST = 6


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of each word on division by the generator."""
    r = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        r = np.where(r >> np.uint32(bit) & 1, r ^ np.uint32(GENERATOR << bit - 11), r)
    return r


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; the errors to try for each syndrome, and how many."""
    errors: dict[int, list[int]] = {}
    weight: dict[int, int] = {}
    for w in range(5):
        words = np.array([sum(1 << i for i in c) for c in combinations(range(23), w)], dtype=np.uint32)
        for word, s in zip(words.tolist(), syndromes(words).tolist(), strict=True):
            if weight.setdefault(s, w) == w or weight[s] == 3:
                errors.setdefault(s, []).append(word)
    table, count = np.zeros((2048, MOST), np.uint32), np.zeros(2048, np.int64)
    for s, found in errors.items():
        table[s, : len(found)], count[s] = found, len(found)
    return syndromes(np.arange(4096)), syndromes(np.arange(2048) << 12), table, count


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For n 23-bit words an (n, 6) array of indices, and how many of them hold for each word."""
    low, high, table, count = _tables()
    words = words.astype(np.uint32)
    s = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ table[s]) >> 11, count[s]


@lru_cache(1)
def _signs() -> np.ndarray:
    """The codewords in order of their indices, as +1 for a one and -1 for a zero."""
    low, high, _, _ = _tables()
    # The upper 12 bits of a codeword are its index; the lower 11 are what makes the remainder zero.
    index = np.arange(4096, dtype=np.uint32) << np.uint32(11)
    words = index | syndromes(index)
    return np.where(words[:, None] >> np.arange(23, dtype=np.uint32) & 1, 1, -1).astype(np.float32)


def nearest(margins: np.ndarray, most: int) -> np.ndarray:
    """Soft decoding: the indices of the `most` codewords that agree best with each row of 23 margins, whose
    signs are the bits and whose sizes say how sure these are."""
    agreement = margins.astype(np.float32) @ _signs().T
    rows, out = np.arange(len(margins)), []
    for _ in range(most):
        out.append(agreement.argmax(axis=1))
        agreement[rows, out[-1]] = -np.inf
    return np.stack(out, axis=1)
