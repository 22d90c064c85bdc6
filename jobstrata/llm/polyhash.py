"""Prefix polynomial hashes modulo 2^64 over bytes, whole arrays at a time.

With an odd base every power has an inverse, so the hash of any stretch comes from two prefixes in constant time and
doesn't depend on where the stretch lies.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _values(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))


class PolyHash:
    """``prefix`` of a byte array, then ``stretch`` for any number of (start, end) pairs. Another seed gives other hashes."""

    def __init__(self, seed: int = 0):
        self.of_byte = _values(seed)
        self.base = (BASE + 2 * int(self.of_byte[7])) % 2**64 | 1
        self._power = self._inverse = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._power) < n:
            with np.errstate(over="ignore"):
                for name, factor in (("_power", self.base), ("_inverse", pow(self.base, -1, 2**64))):
                    steps = np.full(n, factor, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self._power[:n], self._inverse[:n]

    def prefix(self, data: np.ndarray) -> np.ndarray:
        power, _ = self.powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.of_byte[data] * power[:-1], out=sums[1:])
        return sums

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (sums[end] - sums[start]) * self.powers(len(sums))[1][start]
