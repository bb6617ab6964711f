"""Rabin-Karp hashes of every window of a text, for many texts at once, in numpy.

The hash of c[s:s+n] is the sum of (c[s+i]+1) * B^i modulo 2^64; one prefix sum gives any window of any length, since
the odd base has an inverse. The result is mixed, so that its bits can be compared and ordered freely.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _power, _inverse
    if len(_power) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("_power", BASE), ("_inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                globals()[name] = np.cumprod(steps, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; 64-bit numbers to 64-bit numbers, one to one."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Rolling:
    def __init__(self, codes: np.ndarray):
        """``codes``: code points of the text or texts, one after the other."""
        _grow(len(codes) + 1)
        self.n = len(codes)
        self.sums = np.zeros(self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power[: self.n], out=self.sums[1:])

    def at(self, starts: np.ndarray, length) -> np.ndarray:
        """Hashes of the windows at ``starts``; ``length`` is a number or one for each."""
        with np.errstate(over="ignore"):
            return mix((self.sums[starts + length] - self.sums[starts]) * _inverse[starts])

    def every(self, length: int) -> np.ndarray:
        """Hashes of the windows at 0, 1, ..."""
        m = self.n - length + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:m]) * _inverse[:m])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by running minima from both ends of blocks of that width."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])
