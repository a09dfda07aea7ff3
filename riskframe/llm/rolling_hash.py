"""Polynomial hashes of many substrings of a byte buffer at once, modulo 2**64."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); kept for the next call of a similar size."""
    return _powers(base, 1 << max(10, int(n).bit_length()))[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each hash; one to one."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix(buffer: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences are the hashes of substrings."""
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(TABLE[buffer] * powers(BASE, len(buffer)), out=out[1:])
    return out


def substrings(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buffer[start:end] for each pair; equal bytes have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(np.uint64))
