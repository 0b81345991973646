"""Patched frame-of-reference blocks of unsigned integers below 2^32, vectorised over blocks.

A block of 128 values is stored as its minimum, the low ``width`` bits of the differences, and a list
of exceptions: place and high bits of the differences that are wider. The width covers a chosen
percentile of the block. The layout of a record:

    magic "PFR1", values, blocks (uint32 each) | minimum u32, width u8, exceptions u8, start u32 of each block
    (start: of its packed bits, from the end of the header) | packed bits, 16 * width bytes a block | exception places u8 | exception highs u32
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
PERCENTILE = 90
MAGIC = b"PFR1"


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 16 * width) bytes: the low bits of each block's values in little-endian order."""
    low = np.ascontiguousarray(values.T).astype(np.uint64) & np.uint64((1 << width) - 1)
    words = np.zeros((2 * width, values.shape[0]), "<u8")
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        words[word] |= low[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= low[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8)


def _unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").T)
    out = np.empty((BLOCK, packed.shape[0]), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[i] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= words[word + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << width) - 1)).astype(np.uint32).T


def pack(values: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return MAGIC + np.array([0, 0], "<u4").tobytes()
    padded = np.concatenate([values.astype(np.uint32), np.full(blocks * BLOCK - n, values[-1], np.uint32)]).reshape(blocks, BLOCK)
    least = padded.min(1)
    gaps = padded - least[:, None]
    rank = min(BLOCK - 1, BLOCK * percentile // 100)
    typical = np.partition(gaps, rank, axis=1)[:, rank].astype(np.float64)
    width = np.ceil(np.log2(typical + 1)).astype(np.int64)
    wide = (gaps.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    block_of, place = np.nonzero(wide)
    highs = (gaps[block_of, place].astype(np.uint64) >> width[block_of].astype(np.uint64)).astype("<u4")
    sizes = BLOCK // 8 * width
    start = np.cumsum(sizes) - sizes
    payload = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width):
        if not w:
            continue
        own = np.flatnonzero(width == w)
        packed = _pack_bits(gaps[own], int(w))
        payload[start[own][:, None] + np.arange(packed.shape[1])] = packed
    head = [np.array([n, blocks], "<u4"), least.astype("<u4"), width.astype(np.uint8), wide.sum(1).astype(np.uint8), start.astype("<u4")]
    return MAGIC + b"".join(x.tobytes() for x in [*head, payload, place.astype(np.uint8), highs])


def unpack(data: bytes, first: int = 0, end: int | None = None) -> np.ndarray:
    """The values, or those from ``first`` to ``end``: only the blocks that hold them are unpacked."""
    if data[:4] != MAGIC:
        raise ValueError("not a block record")
    n, blocks = np.frombuffer(data, "<u4", 2, 4)
    n, blocks, at = int(n), int(blocks), 12

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    least, width, patched, start = take("<u4", blocks), take("u1", blocks).astype(np.int64), take("u1", blocks).astype(np.int64), take("<u4", blocks).astype(np.int64)
    payload = take("u1", int((BLOCK // 8 * width).sum()))
    places, highs = take("u1", int(patched.sum())), take("<u4", int(patched.sum()))
    end = n if end is None else min(end, n)
    if first >= end:
        return np.zeros(0, np.uint32)
    a, b = first // BLOCK, -(-end // BLOCK)
    out = np.zeros((b - a, BLOCK), np.uint32)
    for w in np.unique(width[a:b]):
        if not w:
            continue
        own = np.flatnonzero(width[a:b] == w)
        packed = payload[start[a:b][own][:, None] + np.arange(BLOCK // 8 * w)]
        out[own] = _unpack_bits(packed, int(w))
    block_of = np.repeat(np.arange(blocks), patched)
    inside = (block_of >= a) & (block_of < b)
    out[block_of[inside] - a, places[inside]] |= highs[inside] << width[block_of[inside]].astype(np.uint32)
    return (out + least[a:b, None]).ravel()[first - a * BLOCK : end - a * BLOCK]
