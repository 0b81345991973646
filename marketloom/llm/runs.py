"""Runs of words that repeat with a period, in texts of any length.

A run is a stretch of words of smallest period q, at least EXPONENT periods and LEAST words long, that no neighbour extends. For each period q
the places 0, q, 2q, ... are tried: a run holds at least three of them that are followed by the same words one period on, and the
common extensions of such a place and the next, forward and backward, are its bounds. All grids together have n (1 + 1/2 + 1/3 + ...)
places. Places whose words differ from those one, two or three periods on are out at once; for the others extensions are looked up
(``extensions``), built only for texts that have such places.

Periods are tried in ascending order, and bounds that a smaller period has found are not found again: a stretch of four periods q with a smaller
period has one that divides q, and the same bounds.

Each text is worked on alone, as its runs are; texts are spread as they are read. A text is held as one number a word and the table of its
distinct words, and grids are walked in blocks, so beside the text a task holds some ten numbers a word.

Cases: null and empty texts, and those without words, have no run and collapse to nothing; a row without doc_id is not rewritten; repeated rows
keep one result each; of runs of one length the least start counts, then the least period; other columns are not read, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column, documents, prepared, table
from .extensions import Extensions

EXPONENT, LEAST = 4, 6
#: Texts are taken apart, and their words joined, so many bytes or words at a time; grids are walked so many places at a time.
PIECE, JOINED, BLOCK = 1 << 20, 1 << 16, 1 << 18
#: The grids of all texts of at most so many words are one list.
SHORT = 4096
#: Of the runs found so far, so many of the longest spare the places of their multiples.
SPARING = 8
FOUND = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")])


def words_of(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the word of each number. Bytes split at just the white space that separates words."""
    number: dict[bytes, int] = {}
    codes, at = [np.zeros(0, np.int32)], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end : end + 1].isspace():  # words stay whole
            end += 1
        words = text[at:end].split()
        for word in set(words):
            number.setdefault(word, len(number))
        codes.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        at = end
    return np.concatenate(codes), list(number)


def rewritten(codes: np.ndarray, doc_id: int | None) -> np.ndarray:
    """Every tenth document repeats a stretch of its words from some place on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not len(codes):
        return codes
    g, n = h // 10, len(codes)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([codes[:a], codes[a + np.arange(n - a) % p]])


def _grid(first: int, last: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all grids of these periods, where three more periods fit into n words."""
    periods = np.arange(first, last + 1)
    places = np.maximum(0, -(-(n - 3 * periods) // periods))
    at = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
    q = np.repeat(periods, places)
    return (at * q).astype(np.int32), q.astype(np.int32)


@cache
def _short_grid() -> tuple[np.ndarray, ...]:
    """(place, period, where a text must have grown to) of all grids of SHORT words, by what a text must hold."""
    i, q = _grid(1, SHORT // 3, SHORT)
    order = np.argsort(i + 3 * q, kind="stable")
    i, q = i[order], q[order]
    return i, i + q, q, np.searchsorted(i + 3 * q, np.arange(SHORT + 1))


def _blocks(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All grids of n words, some at a time, periods ascending."""
    first = 1
    while first <= (n - 1) // 3:
        last, places = first, n // first
        while last < (n - 1) // 3 and places + n // (last + 1) <= BLOCK:
            last += 1
            places += n // last
        i, q = _grid(first, last, n)
        for a in range(0, len(i), BLOCK):
            yield i[a : a + BLOCK], q[a : a + BLOCK]
        first = last + 1


def _alike(c: np.ndarray, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose word comes again one, two and three periods on."""
    for k in (1, 2, 3):
        on = np.flatnonzero(c[i] == c[i + k * q])
        i, q = i[on], q[on]
    return i, q


def candidates(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) where a run may be, periods ascending."""
    n = len(c)
    if n <= SHORT:
        i, next_, q, cut = _short_grid()
        end = cut[n]
        on = np.flatnonzero(c[i[:end]] == c[next_[:end]])
        i, q = _alike(c, i[on], q[on])
        order = np.lexsort((i, q))
        i, q = i[order].astype(np.int64), q[order].astype(np.int64)
        cuts = [0, *np.searchsorted(q, 2 ** np.arange(1, 12)), len(q)]  # a period's multiples come in a later part
        yield from ((i[a:b], q[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a)
    else:
        for i, q in _blocks(n):
            i, q = _alike(c, i, q)
            if len(i):
                yield i.astype(np.int64), q.astype(np.int64)


def runs(c: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of the numbers c, by start, then period."""
    n, found, built = len(c), {}, None
    if n < LEAST:
        return np.zeros((0, 3), np.int64)
    for i, q in candidates(c):
        for start, length, period in sorted(((*b, p) for b, p in found.items()), key=lambda r: -r[1])[:SPARING]:
            other = ~((q % period == 0) & (i >= start) & (i + 3 * q < start + length))
            i, q = i[other], q[other]
        if not len(i):
            continue
        built = built or (Extensions(c), Extensions(c[::-1]))
        ahead = built[0].common(i, i + q)
        behind = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        behind[inner] = built[1].common(n - i[inner], n - i[inner] - q[inner])
        length = ahead + behind + q
        on = np.flatnonzero(length >= np.maximum(LEAST, EXPONENT * q))
        bounds = np.stack([i[on] - behind[on], length[on], q[on]], axis=1)
        for start, size, period in np.unique(bounds, axis=0).tolist():
            found[start, size] = min(period, found.get((start, size), period))
    out = np.array([(*b, p) for b, p in found.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapsed(c: np.ndarray, words: list[bytes], found: np.ndarray) -> str:
    """The digest of the words without those that a run repeats."""
    change = np.zeros(len(c) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    kept = c[np.cumsum(change[:-1]) == 0]
    sha = hashlib.sha256()
    for a in range(0, len(kept), JOINED):
        sha.update(b" " * (a > 0) + b" ".join(map(words.__getitem__, kept[a : a + JOINED].tolist())))
    return sha.hexdigest()


def row_of(doc_id: int | None, text: bytes) -> tuple:
    """What FOUND says of one document."""
    codes, words = words_of(text)
    codes = rewritten(codes, doc_id)
    found = runs(codes)
    most = [None] * 4
    if len(found):
        start, length, period = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
        most = [start, length, period, 1000 * length // period]
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
    return doc_id, len(found), *most, hashlib.sha256(lines.encode()).hexdigest(), collapsed(codes, words, found)


def _periodic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column(batch, "text").cast(pa.large_binary())
        rows = [row_of(d, t.as_py() if t.is_valid else b"") for d, t in zip(column(batch, "doc_id").to_pylist(), texts)]
        if rows:
            yield table(FOUND, **dict(zip(FOUND.names, zip(*rows))))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: how many runs, the longest one, and the digests of all runs and of the text without its repeats."""
    ddl = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in FOUND)
    return docs.select("doc_id", "text").mapInArrow(_periodic, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(documents(prepared(spark), sf_dir))
