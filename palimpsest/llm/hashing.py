"""Vectorised rolling hashes over code points."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Rolling:
    """Hashes of all windows of a length in O(n): sum of mix(c_j) * B^j, times B^-start, modulo 2^64."""

    def __init__(self, base: int, salt: int):
        self.base, self.inverse, self.salt = base | 1, pow(base | 1, -1, 1 << 64), np.uint64(salt)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 14)
            with np.errstate(over="ignore"):
                for name, b in (("powers", self.base), ("inverses", self.inverse)):
                    x = np.full(n, b, np.uint64)
                    x[0] = 1
                    setattr(self, name, np.multiply.accumulate(x))

    def windows(self, points: np.ndarray, width: int) -> np.ndarray:
        n = len(points)
        if n < width:
            return np.empty(0, np.uint64)
        self._grow(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(points.astype(np.uint64) + self.salt) * self.powers[:n], out=sums[1:])
            return mix((sums[width:] - sums[: n - width + 1]) * self.inverses[: n - width + 1])


FIRST, SECOND = (0x9E3779B97F4A7C15, 0x1234567), (0xD6E8FEB86659FD93, 0x7654321)
