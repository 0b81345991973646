"""Suffixes in the order of their bytes: a merge sort whose comparisons look at hashes, in numpy.

Prefix polynomial hashes modulo 2^61 - 1, of a base drawn from a seed, tell in constant time whether two ranges are equal. A
binary search over them finds how far two suffixes agree, and the next byte their order, so a comparison takes some nine steps however
long the common part is. All comparisons of one step of the merge sort are made at once.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np

PRIME = (1 << 61) - 1
SEED = b"suffix order 1"
_P, _LOW31, _LOW30, _LOW32, _LOW29 = (np.uint64(x) for x in (PRIME, (1 << 31) - 1, (1 << 30) - 1, (1 << 32) - 1, (1 << 29) - 1))
_S61, _S31, _S30, _S32, _S29, _S1 = (np.uint64(x) for x in (61, 31, 30, 32, 29, 1))


def _drawn(label: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(label + SEED, digest_size=16).digest(), "little") % (PRIME - 256) + 256


BASE = _drawn(b"base")
_VALUE = np.array([_drawn(b"byte" + bytes([i])) for i in range(256)], np.uint64)
_power = np.ones(1, np.uint64)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it, by halves of 31 bits."""
    a1, a0, b1, b0 = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << _S1) + (middle >> _S30) + ((middle & _LOW30) << _S31) + a0 * b0)


def _powers(n: int) -> np.ndarray:
    """BASE^0 .. BASE^(n - 1), found by doubling."""
    global _power
    while len(_power) < n:
        step = np.uint64(pow(BASE, len(_power), PRIME))
        _power = np.concatenate([_power, times(_power, step)])
    return _power[:n]


class Text:
    """Bytes with the sums of BASE^i times the value of byte i over all prefixes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        terms = times(_VALUE[data], _powers(len(data)))
        # Sums of the halves are exact in 64 bits.
        low, high = np.cumsum(terms & _LOW32, dtype=np.uint64), np.cumsum(terms >> _S32, dtype=np.uint64)
        high = _reduced(high)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        self.sums[1:] = _reduced(_reduced(((high & _LOW29) << _S32) + (high >> _S29)) + _reduced(low))

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Whether the ranges of this length that begin at a and b have equal hashes."""
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        left = _reduced(self.sums[lo + length] + (_P - self.sums[lo]))
        right = _reduced(self.sums[hi + length] + (_P - self.sums[hi]))
        return times(left, _power[hi - lo]) == right

    def before(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the suffix at a sorts before the one at b by their first ``length`` bytes."""
        out = np.zeros(len(a), bool)
        at = np.flatnonzero(~self.same(a, b, length))
        a, b = a[at], b[at]
        known, bound = np.zeros(len(a), np.int64), np.full(len(a), length - 1)  # they agree so far, and no further
        while (known < bound).any():
            middle = (known + bound + 1) // 2
            agree = self.same(a, b, middle)
            known, bound = np.where(agree, middle, known), np.where(agree, bound, middle - 1)
        out[at] = self.data[a + known] < self.data[b + known]
        return out


def merge_sorted(text: Text, start: np.ndarray, first: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Places of the suffixes ``start`` so that each stretch of them is in order. first, size: of the stretch that each is in."""
    n = len(start)
    order, place = np.arange(n), np.arange(n)
    inside, width = place - first, 1
    while width < size.max(initial=0):
        head = first + inside // (2 * width) * 2 * width
        right = inside % (2 * width) >= width
        base = head + width
        left = np.flatnonzero(~right & (base < first + size))
        x = start[order[left]]
        lo, hi = base[left], np.minimum(base[left] + width, (first + size)[left])
        while len(at := np.flatnonzero(lo < hi)):
            middle = (lo[at] + hi[at]) // 2
            less = text.before(start[order[middle]], x[at], length)
            lo[at], hi[at] = np.where(less, middle + 1, lo[at]), np.where(less, hi[at], middle)
        # Each left suffix moves behind the right ones that sort before it; the right ones take the places left over.
        to = place.copy()
        to[left] += lo - base[left]
        merged = np.full(n, -1)
        merged[to[~right]] = order[~right]
        merged[merged < 0] = order[right]
        order, width = merged, 2 * width
    return order


def repeating(data: np.ndarray, start: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """Places of the suffixes that share their first ``length`` bytes with another of the same key, in ascending order.

    Hashes propose, bytes decide: neighbours that look equal are compared, whole stretches of them at once, and where
    that fails the key's suffixes are counted by their bytes.
    """
    by_key = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], np.diff(key[by_key]) != 0])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(new, len(key)))
    first, size = np.repeat(new, sizes), np.repeat(sizes, sizes)
    some = size > 1
    by_key, size = by_key[some], size[some]
    if not len(by_key):
        return by_key
    first = np.repeat(np.cumsum(sizes[sizes > 1]) - sizes[sizes > 1], sizes[sizes > 1])
    text = Text(data)
    order = np.arange(len(by_key))
    # Two suffixes need no order.
    many = np.flatnonzero(size > 2)
    if len(many):
        # Stretches keep their sequence, so what lies before each of them is counted anew.
        rank = np.cumsum(size > 2) - 1
        order[many] = many[merge_sorted(text, start[by_key[many]], rank[first[many]], size[many], length)]
    sorted_at = by_key[order]
    a, b = start[sorted_at[:-1]], start[sorted_at[1:]]
    equal = np.flatnonzero((first[:-1] == first[1:]))
    equal = equal[text.same(a[equal], b[equal], length)]
    wrong = _unequal(data, a[equal], b[equal], length)
    hit = np.zeros(len(start), bool)
    hit[sorted_at[equal]] = hit[sorted_at[equal + 1]] = True
    for k in np.unique(key[sorted_at[equal[wrong]]]):
        own = np.flatnonzero(key == k)
        heads = [data[s : s + length].tobytes() for s in start[own].tolist()]
        n = Counter(heads)
        hit[own] = [n[h] > 1 for h in heads]
    return np.flatnonzero(hit)


def _unequal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which pairs of ranges differ in their bytes. Pairs that follow each other byte by byte are read as one."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((a, b - a))
    a, b = a[order], b[order]
    run = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1)])) if len(a) else np.zeros(0, np.int64)
    body, wrong = data.tobytes(), []
    for i, j in zip(run.tolist(), np.append(run[1:], len(a)).tolist()):
        p, q, n = int(a[i]), int(b[i]), j - i - 1 + length
        if body[p : p + n] != body[q : q + n]:
            wrong += [k for k in range(i, j) if body[a[k] : a[k] + length] != body[b[k] : b[k] + length]]
    return order[wrong]
