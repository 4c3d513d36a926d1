"""Word shingles of batches of texts as sorted 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .common import SLICE, mixed

WIDTH = 5
#: Word hashes that a worker keeps.
CACHED = 250_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHED:
            self.clear()
        self[word] = found
        return found


_HASHES = _WordHashes()


_SPACE = re.compile(rb"[ \t\n\r\x0b\f]")


def word_ids(raw: bytes) -> np.ndarray:
    """The hash of each word, parted by ASCII white space. Long texts are split in parts, so that their words are
    never held as objects all together."""
    found, at = [], 0
    while len(raw) - at > SLICE and (space := _SPACE.search(raw, at + SLICE)):
        words = raw[at : space.start()].split()
        found.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
        at = space.end()
    words = (raw[at:] if at else raw).split()
    found.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
    return found[0] if len(found) == 1 else np.concatenate(found)


def word_hashes(text: str) -> np.ndarray:
    """The same of A-Z lower-cased."""
    return word_ids(text.encode().lower())


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of `width` words of a text as sorted 64-bit hashes: A-Z lower-cased, words parted by
    ASCII white space. Fewer words make one shingle; no word makes none."""
    ids = word_ids(raw.lower())
    if len(ids) >= width:
        rolled = ids[: len(ids) - width + 1].copy()
        for j in range(1, width):
            rolled *= _STEP
            rolled += ids[j : j + len(rolled)]
        return np.unique(mixed(rolled))
    if not len(ids):
        return ids
    h = np.array([len(ids)], np.uint64)
    for x in ids:
        h = h * _STEP + x
    return mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
