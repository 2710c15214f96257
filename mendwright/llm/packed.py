"""Sorted keys and counts as compact binary values, and the cutting of a key space into buckets."""

from __future__ import annotations

import zlib

import numpy as np


def pack(keys: np.ndarray) -> bytes:
    """Ascending distinct keys: the first, then the differences, of as many bytes as the largest needs, byte by byte."""
    if not len(keys):
        return b""
    steps = np.diff(keys).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1)
    full = np.zeros((raw.shape[1] + 1, 8), np.uint8)
    full[0] = np.frombuffer(data, np.uint8, 8, 1)
    full[1:, :width] = raw.T
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    low = np.minimum(counts, 255).astype(np.uint8)
    high = counts[counts >= 255].astype("<u8")
    return zlib.compress(np.array([len(low)], "<u8").tobytes() + low.tobytes() + high.tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    counts = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", offset=8 + n)
    return counts


def filled(keys: np.ndarray, bits: int, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the buckets that the ascending keys of ``bits`` bits fall into; others cost nothing. Buckets, at
    most 2^32, cut the key space evenly by the upper 32 bits."""
    high = keys >> np.uint64(bits - 32) if bits >= 32 else keys << np.uint64(32 - bits)
    bucket = (high * np.uint64(buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
    return list(zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)) if len(starts) else []
