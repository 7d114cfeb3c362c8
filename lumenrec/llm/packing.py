"""Whole numbers as bytes, for rows that hold many: sorted keys by their gaps, small numbers by their planes of bytes."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<IB")
_KEYS = struct.Struct("<QIB")


def squeeze(x: np.ndarray) -> bytes:
    """``x`` (uint64) plane by plane, without the planes that are zero throughout, compressed."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return _HEAD.pack(len(x), width) + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def expand(data: bytes, at: int = 0) -> np.ndarray:
    n, width = _HEAD.unpack_from(data, at)
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = pa.Codec("zstd").decompress(memoryview(data)[at + _HEAD.size :], n * width, asbytes=True)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def pack(keys: np.ndarray) -> bytes:
    """Sorted ``keys`` (uint64): their low bytes, which are as good as random, as they are; the gaps between the rest squeezed."""
    n = len(keys)
    gap = int(keys[-1] - keys[0]) / n if n else 0
    low = min(7, int((math.log2(gap) + 4) / 8)) if gap >= 1 else 0
    high = keys >> np.uint64(8 * low)
    first = int(high[0]) if n else 0
    gaps = np.diff(high, prepend=high[:1])
    return _KEYS.pack(first, n, low) + keys.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :low].tobytes() + squeeze(gaps)


def unpack(data: bytes) -> np.ndarray:
    first, n, low = _KEYS.unpack_from(data)
    high = np.cumsum(expand(data, _KEYS.size + n * low)) + np.uint64(first)
    out = (high << np.uint64(8 * low)).astype("<u8").view(np.uint8).reshape(-1, 8)
    out[:, :low] = np.frombuffer(data, np.uint8, n * low, _KEYS.size).reshape(n, low)
    return out.reshape(-1).view("<u8")
