"""A hash table over 64-bit keys for many lookups at once."""

from __future__ import annotations

import re

import numpy as np

from .common import mixed

STEP = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Open addressing in two arrays, at most two thirds full. Keys are not negative; get() gives `missing` for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing):
        bits = max(4, int(1.5 * len(keys)).bit_length())
        self.shift, self.missing = np.uint64(64 - bits), values.dtype.type(missing)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, missing, values.dtype)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            slot, first = np.unique(at[free], return_index=True)
            self.keys[slot], self.values[slot] = keys[free[first]], values[free[first]]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * STEP) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.values[at], self.missing)
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            held = self.keys[at[left]]
            hit = held == keys[left]
            found[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held != -1)]
        return found


#: What words are known by: a number for each byte (white space: none), and a base whose powers stand for places.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_BYTES[[9, 10, 11, 12, 13, 32]] = 0
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE = re.compile(rb"[ \t\n\r\x0b\f]")


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """63 bits for each word of a text, parted by ASCII white space; where words begin and end. Sums of the numbers of
    bytes, each times a power for its place, less the power of the word's first place."""
    if len(raw) > len(_POWERS[0]):
        for k, base in enumerate((int(STEP), pow(int(STEP), -1, 1 << 64))):
            _POWERS[k] = np.full(len(raw) + 1, base, np.uint64)
            _POWERS[k][0] = 1
            np.cumprod(_POWERS[k], out=_POWERS[k])
    numbers = _BYTES[np.frombuffer(raw, np.uint8)]
    inside = np.concatenate([[False], numbers != 0, [False]])
    borders = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = borders[::2], borders[1::2]
    if not len(starts):
        return np.empty(0, np.int64), starts, ends
    numbers *= _POWERS[0][: len(numbers)]
    sums = np.add.reduceat(numbers, starts) * _POWERS[1][starts]
    return (mixed(sums) >> np.uint64(1)).astype(np.int64), starts, ends
