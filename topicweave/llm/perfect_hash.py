"""Minimal perfect hashing of sets of 64-bit numbers, in arrays.

A level is a bit array of ``GAMMA`` bits for each number. A number that is alone at its place sets the bit; the others go to the
next level, until none is left. The place of a number in the table is the number of bits set before its own, so n numbers get
the places 0 to n - 1 and the structure takes about three bits for each. A number that is not in the set gets some place
or none: whoever looks up compares the number that is stored there.

The numbers are dealt to ``SHARDS`` shards by hash, each with levels of its own, so that shards are built
independently; their levels follow each other in one array of words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SHARDS = 256
GAMMA = 1.5


def mix(values: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each number."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shard_of(values: np.ndarray) -> np.ndarray:
    return (mix(values, -1) & np.uint64(SHARDS - 1)).astype(np.int64)


def build(values: np.ndarray) -> list[np.ndarray]:
    """Levels of distinct numbers: for each the words of its bits."""
    levels, left = [], values.astype(np.uint64)
    while len(left):
        words = -(-int(GAMMA * len(left) + 1) // 64)
        at = (mix(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
        alone = np.bincount(at, minlength=words * 64) == 1
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~alone[at]]
    return levels


@dataclass
class PerfectHash:
    """Levels of some shards: ``first`` (first word of each level) and ``sizes`` (its words), by shard and level."""

    words: np.ndarray
    before: np.ndarray
    first: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, shards: dict[int, list[np.ndarray]]) -> PerfectHash:
        depth = max((len(levels) for levels in shards.values()), default=0)
        first, sizes = np.zeros((SHARDS, depth), dtype=np.int64), np.zeros((SHARDS, depth), dtype=np.int64)
        parts, at = [], 0
        for shard in sorted(shards):
            for i, level in enumerate(shards[shard]):
                first[shard, i], sizes[shard, i] = at, len(level)
                parts.append(level)
                at += len(level)
        words = np.concatenate(parts) if parts else np.zeros(0, dtype="<u8")
        before = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        return cls(words, np.concatenate([[0], before[:-1]]) if len(before) else before, first, sizes)

    def places(self, values: np.ndarray) -> np.ndarray:
        """Place of each number; -1 where it is surely not in the set."""
        values = values.astype(np.uint64)
        out = np.full(len(values), -1, dtype=np.int64)
        shards = shard_of(values)
        left = np.arange(len(values))
        for level in range(self.sizes.shape[1]):
            left = left[self.sizes[shards[left], level] > 0]
            if not len(left):
                break
            of = shards[left]
            at = (mix(values[left], level) % (self.sizes[of, level].astype(np.uint64) * np.uint64(64))).astype(np.int64)
            word, bit = self.first[of, level] + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        return out
