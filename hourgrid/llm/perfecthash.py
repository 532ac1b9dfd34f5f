"""Minimal perfect hashing of 64-bit keys by levels of collision-free bits.

Keys are thrown into a bit array of GAMMA times their number; a place that one key alone hits is marked, and the keys
of the other places go on to the next, smaller array.  A key's number is the count of marks before its own, so n keys
get the numbers 0 to n - 1, whatever the keys.  A key outside the set may get a number too; the caller tells it
by a stored fingerprint.
"""

from __future__ import annotations

import numpy as np

from hourgrid.llm.textscan import mix

GAMMA = 2
#: Bits between two stored counts of marks.
STEP = 512
_ODD = 0x9E3779B97F4A7C15
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64(_ODD * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """``sizes``: bits of every level, each a multiple of eight.  ``bits``: all levels, packed."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes.astype(np.int64), bits
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        ones = _ONES[np.concatenate([bits, np.zeros(-len(bits) % (STEP // 8), np.uint8)])].reshape(-1, STEP // 8).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys."""
        left, sizes, bits = np.asarray(keys, np.uint64), [], []
        if len(np.unique(left)) != len(left):
            raise ValueError("a perfect hash needs distinct keys")
        while len(left):
            size = -(-GAMMA * len(left) // 8) * 8
            at = _place(left, len(sizes), size)
            hits = np.bincount(at, minlength=size)
            sizes.append(size)
            bits.append(np.packbits(hits == 1, bitorder="little"))
            left = left[hits[at] > 1]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, np.uint8))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key; -1 for keys that no level marks."""
        keys = np.asarray(keys, np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.first[level] + _place(keys[left], level, int(size))
            marked = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[left[marked]] = self._rank(at[marked])
            left = left[~marked]
        return out

    def _rank(self, at: np.ndarray) -> np.ndarray:
        block = at // STEP
        width = STEP // 8
        held = np.concatenate([self.bits, np.zeros(width, np.uint8)])
        inside = held[(block * width)[:, None] + np.arange(width)]
        byte = ((at % STEP) >> 3)[:, None]
        mask = np.where(np.arange(width) < byte, 255, 0).astype(np.uint8)
        rows = np.arange(len(at))
        mask[rows, byte[:, 0]] = (1 << (at & 7)) - 1
        return self.before[block] + _ONES[inside & mask].sum(1, dtype=np.int64)
