"""The perfect binary Golay code of 23 bits: 4,096 codewords, and each 23-bit vector within 3 bits of exactly one."""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS, INDEX_BITS = 23, 12
CHECKS = BITS - INDEX_BITS
#: The code's generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1. Fixed value.
GENERATOR = 0b101011100011


def _rest(vectors: np.ndarray) -> np.ndarray:
    """The 11-bit remainder of each vector by the generator."""
    left = vectors.astype(np.int64)
    for shift in range(INDEX_BITS - 1, -1, -1):
        left = np.where((left >> (shift + CHECKS)) & 1, left ^ (GENERATOR << shift), left)
    return left


def _nearest_errors() -> np.ndarray:
    """For each remainder the only error of at most 3 bits that leaves it."""
    errors = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(BITS), n)])
    table = np.zeros(1 << CHECKS, dtype=np.int64)
    table[_rest(errors)] = errors
    return table


_ERRORS = _nearest_errors()
_BYTES = [_rest(np.arange(256) << shift).astype(np.int64) for shift in (0, 8, 16)]


def decoded(vectors: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit vector."""
    v = vectors.astype(np.int64)
    rest = _BYTES[0][v & 255] ^ _BYTES[1][v >> 8 & 255] ^ _BYTES[2][v >> 16]  # the remainder is linear
    return (v ^ _ERRORS[rest]) >> CHECKS
