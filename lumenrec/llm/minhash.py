"""MinHash signatures of many sets at a time, banded into bucket keys."""

from __future__ import annotations

import numpy as np

from .textops import mix

_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: After so many draws of a full bin a set takes its overall minimum instead.
_DRAWS = 200


def one_permutation(items: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys (sets, bands) of sets that lie one after another in ``items`` (64-bit hashes); each has an item.

    An item's hash says its bin and its rank in the bin, and a bin's value is its lowest rank,
    so a set is hashed once, whatever the number of bins. An empty bin takes the value of
    another, drawn by a hash of the bin and the attempt alone, so that two sets of Jaccard
    similarity j agree in a bin with probability j. They share the key of one band with
    probability j ** rows.
    """
    bins, n = bands * rows, len(counts)
    cell = (items >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
    cell += np.repeat(np.arange(n, dtype=np.uint64) * np.uint64(bins), counts)
    low = np.full(n * bins, _EMPTY)
    np.minimum.at(low, cell.astype(np.int64), items & np.uint64(0xFFFFFFFF))
    low = low.reshape(n, bins)
    full = low.copy()
    of, at = np.nonzero(low == _EMPTY)
    for attempt in range(1, _DRAWS + 1):
        if not len(of):
            break
        drawn = (mix((at + 1).astype(np.uint64) * _ODD ^ np.full(len(at), attempt, np.uint64) * _STEP) % np.uint64(bins)).astype(np.int64)
        value = low[of, drawn]
        ok = value != _EMPTY
        full[of[ok], at[ok]] = value[ok]
        of, at = of[~ok], at[~ok]
    if len(of):
        full[of, at] = low.min(axis=1)[of]
    keys = np.empty((n, bands), np.uint64)
    for band in range(bands):
        key = np.full(n, band + 1, np.uint64) * _STEP
        for row in range(rows):
            key = mix(key + full[:, band * rows + row] * _ODD)
        keys[:, band] = key
    return keys

