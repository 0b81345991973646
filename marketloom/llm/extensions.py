"""Longest common extensions of a sequence by a difference cover, in numpy.

Of all suffixes only those that begin at a place whose residue modulo PERIOD is in COVER are sorted. Any two places i and j have a shift
below PERIOD that brings both to such places, as every residue is a difference of two in COVER. So the common extension of i and j is
what agrees in these few items, or the items and the common prefix of two sorted suffixes, which is the least of the common prefixes of neighbours
between them: one look at a sparse table.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference cover: each residue but zero is one difference.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def _shifts() -> np.ndarray:
    """shift[i % PERIOD, j % PERIOD]: the least number of items after which both places are in the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    at = np.arange(PERIOD)
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    for shift in reversed(range(PERIOD)):
        out[np.ix_(inside[at + shift], inside[at + shift])] = shift
    if (out < 0).any():
        raise ValueError("not a difference cover")
    return out


SHIFT = _shifts()


class Extensions:
    """Common extensions in an array of int32 codes that are not negative."""

    def __init__(self, codes: np.ndarray):
        self.n = n = len(codes)
        # Past the end stand numbers below all codes. Two places differ, so one of them gets there first.
        self.codes = np.concatenate([codes, np.full(2 * PERIOD, -1, np.int32)])
        sampled = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
        self.place = np.full(n, -1, np.int32)
        self.place[sampled] = np.arange(len(sampled), dtype=np.int32)
        self._sort(sampled)

    def _sort(self, sampled: np.ndarray) -> None:
        """Ranks of the sampled suffixes by doubling in steps of PERIOD, then the common prefixes of neighbours from the ranks of each step."""
        window = np.lib.stride_tricks.sliding_window_view(self.codes, PERIOD)
        rows = np.ascontiguousarray(window[sampled])
        _, rank = np.unique(rows.view(np.dtype((np.void, rows.itemsize * PERIOD))).ravel(), return_inverse=True)
        ranks, step, m = [rank.astype(np.int32)], PERIOD, len(sampled)
        while ranks[-1].max(initial=0) + 1 < m:  # a suffix that ends within the items seen so far is like no other
            later = sampled + step
            inside = later < self.n
            follow = np.zeros(m, np.int64)
            follow[inside] = ranks[-1][self.place[later[inside]]] + 1
            _, rank = np.unique(ranks[-1].astype(np.int64) * (m + 1) + follow, return_inverse=True)
            ranks.append(rank.astype(np.int32))
            step *= 2
        self.rank = ranks[-1]
        order = np.argsort(self.rank)
        a, b = sampled[order[:-1]].copy(), sampled[order[1:]].copy()
        common = np.zeros(max(0, m - 1), np.int64)
        for rank in reversed(ranks[:-1]):
            step //= 2
            on = (a < self.n) & (b < self.n)
            on[on] = rank[self.place[a[on]]] == rank[self.place[b[on]]]
            common[on] += step
            a[on] += step
            b[on] += step
        common += self._few(a, b, np.full(len(a), PERIOD))
        self.tables = [common]
        while 2 ** len(self.tables) <= len(common):
            half, last = 2 ** (len(self.tables) - 1), self.tables[-1]
            self.tables.append(np.minimum(last[: len(last) - half], last[half:]))

    def _few(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Items that agree from i and j on, at most so many (up to PERIOD)."""
        out, on, k = np.zeros(len(i), np.int64), np.flatnonzero(most > 0), 0
        last = len(self.codes) - 1
        while len(on):
            on = on[self.codes[np.minimum(i[on] + k, last)] == self.codes[np.minimum(j[on] + k, last)]]
            k += 1
            out[on] = k
            on = on[most[on] > k]
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different places, how many items agree from there on."""
        shift = SHIFT[i % PERIOD, j % PERIOD]
        out = self._few(i, j, shift)
        on = np.flatnonzero((out == shift) & (np.maximum(i, j) + shift < self.n))
        if len(on):
            p, q = self.rank[self.place[i[on] + shift[on]]], self.rank[self.place[j[on] + shift[on]]]
            low, high = np.minimum(p, q), np.maximum(p, q)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            found = np.zeros(len(on), np.int64)
            for k in np.unique(level):
                some = level == k
                found[some] = np.minimum(self.tables[k][low[some]], self.tables[k][high[some] - 2**k])
            out[on] += found
        return np.minimum(out, self.n - np.maximum(i, j))
