"""Word shingles of whole texts as sorted distinct 64-bit hashes, and their minhashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import SLICE_BYTES, slices

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose output bits all depend on all input bits."""
    x = x + _GOLD
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


_BYTE = mixed(np.arange(256, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_power = np.ones(1, np.uint64)


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    global _power
    if len(_power) < n:
        steps = np.full(2 * n, base, np.uint64)
        steps[0] = 1
        _power = np.cumprod(steps, dtype=np.uint64)
    return _power[:n]


def word_hashes(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of the rows that start at ``at`` in the bytes; A-Z counts as a-z."""
    space = _SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = space[:-1]
    first[at[:-1][np.diff(at) > 0]] = True
    start = np.flatnonzero(first & ~space)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    index = np.arange(len(data))
    inside = index - np.maximum.accumulate(np.where(first & ~space, index, 0))
    terms = _BYTE[_LOWER[data]] * powers(int(inside.max()) + 1)[inside]
    terms[space] = 0
    return mixed(np.add.reduceat(terms, start)), np.searchsorted(at, start, "right") - 1


def long_word_hashes(data: np.ndarray, piece: int = SLICE_BYTES) -> np.ndarray:
    """As ``word_hashes`` of one row, piece by piece: what it holds beside the words does not grow with the text, even if it is one word."""
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    done, begun, size = [np.zeros(0, np.uint64)], 0, 0  # the sum and length of a word that began in an earlier piece
    for a in range(0, len(data), piece):
        part = data[a : a + piece]
        space = _SPACE[part]
        start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if size and space[0]:
            done.append(np.array([begun], np.uint64))
            begun = size = 0
        if not len(start):
            continue
        index = np.arange(len(part))
        inside = index - np.maximum.accumulate(np.where(np.isin(index, start), index, 0))
        terms = _BYTE[_LOWER[part]] * powers(int(inside.max()) + 1)[inside]
        terms[space] = 0
        sums = np.add.reduceat(terms, start)
        if size:
            sums[0] = (begun + int(sums[0]) * pow(base, size, 1 << 64)) & mask
        if space[-1]:
            begun = size = 0
        else:
            size = (size if len(start) == 1 else 0) + len(part) - int(start[-1])
            begun, sums = int(sums[-1]), sums[:-1]
        done.append(sums)
    if size:
        done.append(np.array([begun], np.uint64))
    return mixed(np.concatenate(done))


def words_apart(at: np.ndarray, data: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the rows that start at ``at`` in the bytes, A-Z as a-z, each followed by one space: (bytes, start and length of each word in them, its row)."""
    letter = ~_SPACE[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    row_starts = at[:-1][np.diff(at) > 0]
    first[row_starts] = letter[row_starts]
    begin = np.flatnonzero(first)
    size = np.add.reduceat(letter, begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)
    ends = np.cumsum(size + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = _LOWER[data[letter]]
    return out.tobytes(), ends - size - 1, size, np.searchsorted(at, begin, "right") - 1


def _shingles(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of every k words in a row, k being the number of weights."""
    n = max(0, len(words) - len(weights) + 1)
    whole = np.zeros(n, np.uint64)
    for j, w in enumerate(weights):
        whole += words[j : j + n] * w
    return mixed(whole)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, a sorted array of distinct shingle hashes for each row from it on), slice by slice.

    A text of fewer than k words, but at least one, has its whole sequence as its one shingle.
    """
    weights = mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    for first, end, at, data in slices(texts):
        if end == first + 1 and len(data) > SLICE_BYTES:
            words = long_word_hashes(data)
            cuts = np.array([0, len(words)])
        else:
            words, row = word_hashes(at, data)
            cuts = np.searchsorted(row, np.arange(end - first + 1))
        whole = _shingles(words, weights)
        sets = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a >= k:
                sets.append(np.unique(whole[a : b - k + 1]))
            elif b > a:
                sets.append(mixed((words[a:b] * weights[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield first, sets


def minhashes(sets: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """(rows, seeds) 32-bit minima; rows with an empty set hold the largest value."""
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), len(seeds)), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        cuts = np.cumsum(sizes[some]) - sizes[some]
        for j, seed in enumerate(seeds):
            z = (flat ^ seed) * _M1
            z = (z ^ z >> np.uint64(29)) * _M2
            out[some, j] = np.minimum.reduceat(z >> np.uint64(32), cuts)
    return out
