"""The perfect binary Golay code of length 23: decoding of vectors to codeword indices, in numpy.

Every 23-bit vector lies within 3 bits of exactly one of 4,096 codewords. index() names that codeword. near() names the codewords of the vector and of its 23 neighbours: one for a vector within 2 bits of its codeword, six for the others. So two vectors that differ in 2 bits share an index of near(), by the vector half-way between them, and for vectors that differ in one bit, index() of either is in near() of the other.
"""

from __future__ import annotations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator polynomial of the code.
GENERATOR = 0b110001110101
BITS = 23


def _remainder(v: int) -> int:
    for b in range(BITS - 1, 10, -1):
        if v >> b & 1:
            v ^= GENERATOR << (b - 11)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all vectors' halves (low 12 bits, high 11 bits), and the error that each syndrome stands for."""
    of_bit = [_remainder(1 << b) for b in range(BITS)]
    halves = np.zeros((2, 4096), np.int32)
    for half, start, bits in ((0, 0, 12), (1, 12, 11)):
        for b in range(bits):
            halves[half, 1 << b : 2 << b] = halves[half, : 1 << b] ^ of_bit[start + b]
    errors = np.zeros(2048, np.int32)
    for i in range(BITS):
        errors[of_bit[i]] = 1 << i
        for j in range(i):
            errors[of_bit[i] ^ of_bit[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[of_bit[i] ^ of_bit[j] ^ of_bit[k]] = 1 << i | 1 << j | 1 << k
    return halves, errors


HALVES, ERRORS = _tables()


def index(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each vector."""
    v = v.astype(np.int32)
    return (v ^ ERRORS[HALVES[0, v & 4095] ^ HALVES[1, v >> 12]]) >> 11


def near(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) pairs, without repeats, of the codewords nearest to each vector and to its neighbours."""
    flips = np.concatenate([[0], 1 << np.arange(BITS)]).astype(np.int32)
    found = np.sort(index(v.astype(np.int32)[:, None] ^ flips), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(first)[0], found[first]
