"""Counts that quality rules look at, computed for whole texts in batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_CONTINUING = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\r\x0b\f"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words which occurs twice or more, first occurrences included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    size = len(numbers)
    if size == len(words):
        return 0
    key = ids[:n]
    for j in range(1, width):
        # numbered again at each step: no overflow, no collision
        key = np.unique(key, return_inverse=True)[1] * size + ids[j : j + n]
    inverse, counts = np.unique(key, return_inverse=True, return_counts=True)[1:]
    hit = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for j in range(width):
        covered[j : j + n] |= hit
    return int(covered.sum())


def features(raw: bytes) -> tuple[int, ...]:
    """FEATURES of one text, given as UTF-8. Words are parted by ASCII white space, lines by newlines; lines
    without a word don't count."""
    words = raw.split()
    packed = raw.translate(None, _SPACE)
    # code points: the bytes that don't continue one
    chars = len(packed.translate(None, _CONTINUING))
    symbols = len(raw.translate(None, _NOT_SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeat_words(words), len(lines)


def of_batch(texts: pa.Array) -> list[pa.Array]:
    rows = [features(x or b"") for x in texts.cast(pa.binary()).to_pylist()]
    return [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(FEATURES))]
