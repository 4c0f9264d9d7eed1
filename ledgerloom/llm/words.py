"""Words of many texts at once, and hashes of their runs, in numpy arrays."""

from __future__ import annotations

import functools

import numpy as np

#: What parts words: space and \t to \r.
BREAKS = (32, 9, 10, 11, 12, 13)
BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@functools.cache
def break_table() -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(BREAKS)] = True
    return out


@functools.lru_cache(maxsize=3)
def base_powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
    return up, down


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below ``size`` at least; the usual sizes share one table, and larger ones aren't kept."""
    usual = 1 << 19
    return base_powers(base, usual) if size <= usual else base_powers.__wrapped__(base, size)


def run_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[first:last] for each pair, whatever its place."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    h = (total[last] - total[first]) * down[first]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last + 1 byte of each word, and each text's first word (with one more for the end)."""
    gap = break_table()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(~gap & (edge[:-1] | np.concatenate([[True], gap[:-1]])[: len(gap)]))
    ends = np.flatnonzero(~gap & (edge[1:] | np.concatenate([gap[1:], [True]])[: len(gap)])) + 1
    return starts, ends, np.searchsorted(starts, at)


def window_anchors(data: np.ndarray, at: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every window's anchor: of its phrases that with the smallest hash, the first of equal ones.

    Equal windows have equal anchors at equal places. Gives the words' starts
    and ends and the texts' first words (as ``word_spans``), the phrases'
    hashes, and for each window start its anchor's word (-1 where no window starts).
    """
    starts, ends, first = word_spans(data, at)
    if len(starts) < window:
        return starts, ends, first, np.zeros(0, np.uint64), np.full(len(starts), -1)
    words = run_hashes(data, starts, ends, BASE)
    n = len(words) - phrase + 1
    grams = run_hashes(words, np.arange(n), np.arange(phrase, phrase + n), WORD_BASE)
    reach = window - phrase + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, reach)
    anchor = np.full(len(starts), -1)
    anchor[: len(view)] = view.argmin(axis=1) + np.arange(len(view))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    anchor[len(doc) - window + 1 :] = -1
    anchor[: len(doc) - window + 1][doc[window - 1 :] != doc[: len(doc) - window + 1]] = -1
    return starts, ends, first, grams, anchor
