"""The binary Golay code of length 23: every word is within 3 errors of exactly one of 4096 codewords."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, MESSAGE = 23, 12
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator polynomial of the code.
GENERATOR = 0b110001110101


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator: 11 bits that are zero for codewords only."""
    rest = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - (LENGTH - MESSAGE)), 0)
    return rest


@cache
def errors_near() -> np.ndarray:
    """By syndrome, six error patterns that lead to codewords: the one of weight 3 or less, then those of weight 4 (five if the first has weight 3, else none: -1)."""
    out = np.full((1 << (LENGTH - MESSAGE), 6), -1, dtype=np.int64)
    filled = np.zeros(len(out), dtype=np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], dtype=np.int64)
        for pattern, s in zip(patterns, syndromes(patterns), strict=True):
            out[s, filled[s]] = pattern
            filled[s] += 1
    return out


def near_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices (12 bits) of the codewords within 4 errors, -1 where there are fewer.

    Two words that differ in 2 bits at most have one in common: the codeword of a word between them is within 3 of it,
    so within 4 of both.
    """
    errors = errors_near()[syndromes(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> (LENGTH - MESSAGE))
