"""Minimal perfect hashing of 64-bit keys, in numpy."""

from __future__ import annotations

import numpy as np

#: Places per key that is left, on every level.
ROOM = 2

_STEP = 0x9E3779B97F4A7C15


def scrambled(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """One to one on 64 bits."""
    x = x.astype(np.uint64) + np.uint64((seed + 1) * _STEP & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps ``n`` distinct keys to ``0 … n - 1``; some four bits a key.

    On every level the keys that are left are hashed to twice as many places; a
    place met by one key only is that key's, the others go on to the next level.
    A key's slot is the rank of its place among the taken ones of all levels.
    """

    def __init__(self, taken: np.ndarray, sizes: np.ndarray):
        self.taken, self.sizes = taken, sizes
        self.starts = np.cumsum(sizes) - sizes
        self.ranks = (np.cumsum(taken) - taken).astype(np.int32)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = ROOM * len(left)
            place = (scrambled(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[place]]
        sizes = np.array([len(x) for x in levels], np.int64)
        return cls(np.concatenate([*levels, np.zeros(0, bool)]), sizes)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for every key; keys that were not built in get some slot, or -1."""
        slot = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes)):
            if not len(left):
                break
            place = start + (scrambled(keys[left], level) % np.uint64(size)).astype(np.int64)
            here = self.taken[place]
            slot[left[here]] = self.ranks[place[here]]
            left = left[~here]
        return slot

    def packed(self) -> tuple[bytes, list[int]]:
        return np.packbits(self.taken).tobytes(), self.sizes.tolist()

    @classmethod
    def unpacked(cls, taken: bytes, sizes: list[int]) -> PerfectHash:
        bits = np.unpackbits(np.frombuffer(taken, np.uint8), count=int(sum(sizes))).astype(bool)
        return cls(bits, np.asarray(sizes, np.int64))
