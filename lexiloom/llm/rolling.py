"""64-bit hashes of any slice of a byte or word sequence, from prefix sums."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1), np.uint64(base), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer; the argument is overwritten."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Slices:
    """Hashes of slices of one sequence of 64-bit values (or of bytes)."""

    def __init__(self, values: np.ndarray):
        if values.dtype == np.uint8:
            values = _BYTE_VALUES[values]
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal slices; the length is mixed in."""
        out = (self.sums[end] - self.sums[start]) * self.back[start]
        out += (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return mixed(out)
