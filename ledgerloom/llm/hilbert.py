"""Hilbert curve positions of many points at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions of points (rows of unsigned integers below 2**bits) along the Hilbert curve of their cube.

    dims x bits is at most 63. The curve's order is found bit plane by bit
    plane: each plane's reflection or exchange of axes applies to the lower planes,
    and a Gray code ties the axes of a plane together.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        bit, below = np.int64(1) << plane, (np.int64(1) << plane) - 1
        for axis in range(dims):
            on = (x[axis] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(on, below, swap)
            if axis:
                x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where(x[dims - 1] & (np.int64(1) << plane), (np.int64(1) << plane) - 1, 0)
    x ^= turn
    key = np.zeros(len(points), np.int64)
    for plane in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = key << 1 | x[axis] >> plane & 1
    return key
