"""Hashes of stretches of bytes by prefix sums, without a loop over bytes."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return x * np.uint64(0xD6E8FEB86659FD93)


class Hashes:
    """Hashes of any stretches of a text by prefix sums; powers are kept between texts."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) <= n:
            size = 2 * n + 1024
            for name, base in (("up", BASE), ("down", INVERSE)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        return sums

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Of every stretch of ``width``."""
        n = len(sums) - width
        return mixed((sums[width:] - sums[:n]) * self.down[:n])
