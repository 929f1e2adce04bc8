"""Packed arrays of whole numbers: byte planes, compressed, so that small numbers cost little."""

from __future__ import annotations

import numpy as np
import zstandard


def press(values: np.ndarray) -> bytes:
    """Non-negative 64-bit numbers."""
    flat = np.ascontiguousarray(values.astype("<u8", copy=False))
    planes = max(1, -(-int(flat.max()).bit_length() // 8)) if len(flat) else 1
    raw = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def expand(data: bytes) -> np.ndarray:
    planes = data[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(planes, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :planes] = raw.T
    return out.view("<u8").ravel()


def press_sorted(values: np.ndarray) -> bytes:
    return press(np.diff(values.astype("<u8", copy=False), prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data), dtype=np.uint64)


def runs(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, stop) of each run of a sorted array of numbers from 0."""
    at = np.flatnonzero(np.diff(np.r_[-1, shard, -2])) if len(shard) else np.zeros(1, np.int64)
    return [(int(shard[i]), int(i), int(j)) for i, j in zip(at[:-1], at[1:], strict=True)]
