"""Minimal perfect hashing of integer keys by levels of bit arrays, vectorised.

At each level the keys left are hashed into about twice as many places; a key alone on its place stays there, the others go on to
the next level. The number of set bits before a key's place is its index, so n keys get the indexes 0 to n - 1.
"""

from __future__ import annotations

import numpy as np

from . import common as C

GAMMA = 2
STEP = 0x9E3779B97F4A7C15


def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (C.mix64(keys.astype(np.uint64) + np.uint64(STEP * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """``sizes`` of the levels (multiples of 64), the levels' bits in 64-bit ``words``, and set bits before each word (``ranks``)."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.first = np.cumsum(sizes) - sizes
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1] if len(words) else words

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Keys have to be distinct."""
        rest, sizes, words, level = keys, [], [], 0
        while len(rest):
            size = -(-GAMMA * len(rest) // 64) * 64
            at = place(rest, level, size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            rest, level = rest[~alone[at]], level + 1
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(words) if words else np.zeros(0, dtype=np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of every key that was built in; an arbitrary index or -1 for others."""
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (size, first) in enumerate(zip(self.sizes.tolist(), self.first.tolist())):
            if not len(todo):
                break
            at = first + place(keys[todo], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = ((word >> bit) & np.uint64(1)) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = self.ranks[at[hit] >> 6] + below
            todo = todo[~hit]
        return out
