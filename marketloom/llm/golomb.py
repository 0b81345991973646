"""Rice codes (Golomb codes with a power of two) of sorted 64-bit fingerprints, vectorised."""

from __future__ import annotations

import numpy as np


def encode(sorted_values: np.ndarray) -> tuple[int, bytes]:
    """(k, bits) of the gaps between ascending uint64 values, the first counted from 0.

    Each gap is written as gap >> k in unary (ones, then a zero), then its k low bits; all unary parts
    come first, so that decoding is vectorised as well. k is the log of the mean gap, which makes
    the unary parts about two bits each.
    """
    n = len(sorted_values)
    if not n:
        return 0, b""
    gaps = np.diff(sorted_values, prepend=np.uint64(0))
    mean = max(1, int(sorted_values[-1]) // n)
    k = min(63, mean.bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    low = gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :] & np.uint64(1)
    return k, np.packbits(np.concatenate([unary, low.astype(np.uint8).ravel()]), bitorder="little").tobytes()


def decode(n: int, k: int, data: bytes) -> np.ndarray:
    """The n values that ``encode`` was given."""
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    ends = np.flatnonzero(bits == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    start = int(ends[-1]) + 1
    low = bits[start : start + n * k].reshape(n, k).astype(np.uint64) << np.arange(k, dtype=np.uint64)[None, :]
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) + low.sum(1, dtype=np.uint64), dtype=np.uint64)
