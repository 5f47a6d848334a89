"""Vectorised polynomial hashing of byte buffers (numpy, modulo 2**64).

``prefix`` turns a buffer into prefix sums; ``spans`` then hashes any set of
``[start, end)`` ranges in O(1) each. Two independent ``Family`` objects give
128 bits. All constants derive from a fixed splitmix64 stream, so hashes are
the same in every process.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def _splitmix(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = U(seed) + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the weak low bits of a polynomial hash."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(33))
        h = h * U(0xFF51AFD7ED558CCD)
        h = h ^ (h >> U(33))
        h = h * U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U(33))


class Family:
    """One hash function: a random odd base and a random value per byte."""

    def __init__(self, seed: int):
        self.base = int(_splitmix(seed, 1)[0]) | 1
        self.values = _splitmix(seed + 1, 256)
        self._up = np.ones(1, dtype=U)
        self._down = np.ones(1, dtype=U)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                for name, b in (("_up", self.base), ("_down", pow(self.base, -1, 1 << 64))):
                    a = np.full(n, U(b), dtype=U)
                    a[0] = 1
                    setattr(self, name, np.cumprod(a, dtype=U))
        return self._up, self._down

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        """Prefix sums of a uint8 buffer, or of uint64 items taken as they are."""
        up, _ = self._powers(len(buf) + 1)
        out = np.zeros(len(buf) + 1, dtype=U)
        with np.errstate(over="ignore"):
            np.cumsum((self.values[buf] if buf.dtype == np.uint8 else buf) * up[: len(buf)], out=out[1:])
        return out

    def spans(self, pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self._powers(len(pre))
        with np.errstate(over="ignore"):
            return (pre[end] - pre[start]) * down[start]

    def windows(self, pre: np.ndarray, k: int) -> np.ndarray:
        """Hash of every length-k range."""
        if len(pre) <= k:
            return np.zeros(0, dtype=U)
        _, down = self._powers(len(pre))
        with np.errstate(over="ignore"):
            return (pre[k:] - pre[:-k]) * down[: len(pre) - k]


A, B = Family(0x243F6A8885A308D3), Family(0x13198A2E03707344)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive items."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def chunks(lengths: list[int], most: int):
    """Ranges of consecutive items whose lengths sum to at most ``most`` (or one item)."""
    lo = total = 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)
