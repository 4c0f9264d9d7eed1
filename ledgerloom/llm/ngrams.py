"""Letter n-grams of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def letter_table() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def mix(h: np.ndarray) -> np.ndarray:
    """A finishing mix of 64-bit values, so that all of their bits are usable."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def letters(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, the number of each one's text, and whether each text has a letter.

    Every run of non-letters is one 0, and each text starts and ends with one.
    """
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "replace"), np.uint32)
    is_letter = letter_table()[points]
    at = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    doc = np.repeat(np.arange(len(lowered)), np.diff(at))
    doc = np.append(doc, len(lowered))
    has = np.zeros(len(lowered) + 1, bool)
    has[doc[is_letter]] = True
    starts = np.zeros(len(points), bool)
    starts[at] = True
    keep = is_letter | starts
    keep[1:] |= is_letter[:-1]
    return np.where(is_letter, points, 0)[keep], doc[keep], has[:-1]


def ngram_hashes(points: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams with a letter in them, and their texts' numbers.

    An n-gram may begin or end with the 0 at a word's edge and doesn't span two texts.
    """
    if len(points) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    end = len(points) - n + 1
    h = np.full(end, n, np.uint64)
    inner = np.ones(end, bool)
    wide = points.astype(np.uint64)
    for j in range(n):
        h = (h + wide[j : j + end] + np.uint64(1)) * MULT
        if 0 < j < n - 1:
            inner &= points[j : j + end] != 0
    if n == 1:
        inner &= points[:end] != 0
    # a text's own leading 0 may close the n-gram of the text before it
    last, first = doc[n - 1 :], doc[:end]
    inner &= (last == first) | ((last == first + 1) & (points[n - 1 :] == 0))
    if n == 2:
        inner &= (points[:end] != 0) | (points[1:] != 0)
    return mix(h[inner]), first[inner]
