"""Periodic runs and common extensions against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from marketloom.llm import common, extensions, runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(c):
    """Every run, by walking each period over the whole sequence."""
    n, found = len(c), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and c[j] == c[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, size, q) for (s, size), q in found.items())


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    most = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (*most, 1000 * most[1] // most[2]) if most else (None,) * 4
    return doc_id, len(found), *best, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))


def repeating(rnd, n, letters):
    c = [rnd.randrange(letters) for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):
        if n > 10:
            start, p = rnd.randrange(n), rnd.randint(1, 20)
            for x in range(start + p, min(n, start + p * rnd.randint(2, 9) + rnd.randint(0, p))):
                c[x] = c[x - p]
    return c


@pytest.mark.parametrize("short,block", [(4096, 1 << 18), (5, 64)])
def test_runs_against_brute_force(monkeypatch, short, block):
    monkeypatch.setattr(runs, "SHORT", short)
    monkeypatch.setattr(runs, "BLOCK", block)
    runs._short_grid.cache_clear()
    rnd = random.Random(short)
    for _ in range(400):
        c = repeating(rnd, rnd.randint(0, 200), rnd.choice([1, 2, 2, 3, 4, 8]))
        assert [tuple(r) for r in runs.runs(np.array(c, np.int32)).tolist()] == plain_runs(c)
    runs._short_grid.cache_clear()


def test_runs_within_runs():
    """(a a a a a a b) four times: the period of seven, and a run of ones in each."""
    c = ([0] * 6 + [1]) * 4
    assert plain_runs(c) == [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)]
    assert [tuple(r) for r in runs.runs(np.array(c, np.int32)).tolist()] == plain_runs(c)


def test_extensions_against_plain_comparison():
    rnd = random.Random(4)
    for n in [*range(1, 12), 31, 62, 63, 400, 3000]:
        c = repeating(rnd, n, 2)
        i, j = np.array([[rnd.randrange(n), rnd.randrange(n)] for _ in range(200)]).T
        i, j = i[i != j], j[i != j]
        got = extensions.Extensions(np.array(c, np.int32)).common(i, j)
        for a, b, size in zip(i.tolist(), j.tolist(), got.tolist()):
            assert c[a : a + size] == c[b : b + size] and (max(a, b) + size == n or c[a + size] != c[b + size])


def test_the_cover_has_every_difference():
    assert {(a - b) % extensions.PERIOD for a in extensions.COVER for b in extensions.COVER} == set(range(extensions.PERIOD))
    assert extensions.SHIFT.max() < extensions.PERIOD


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(spark):
    common.prepared(spark)
    tenth = [d for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0]
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "a a a a a a"), (5, "a a a a a"), (6, "a b a b a b a b c"), (6, "a b a b a b a b c"), (6, "other text"), (None, "x " * 9),
        (7, "É é É é É é É é\x85 x\x0bx\x0cx\x1cx"), (8, "a b " * 5 + "c d " * 5), (9, "x" * 5000), *[(d, " ".join(str(k) for k in range(60 + d))) for d in tenth], (tenth[0], None), (tenth[1], "one"),
    ]
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, period string")
    assert got(runs.periodic_runs(wide)) == sorted((plain_row(*r) for r in rows), key=str)
    assert got(runs.periodic_runs(wide.limit(0))) == []
    assert any(r.n_runs for r in runs.periodic_runs(wide).collect() if r.doc_id in tenth)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in common.documents(spark, SF).collect()]
    assert got(runs.query(common.prepared(spark), SF)) == sorted((plain_row(*r) for r in docs), key=str)


def test_texts_of_twenty_megabytes():
    n, start, length, period = runs.row_of(None, b"word " * 4_000_000)[1:5]
    assert (n, start, length, period) == (1, 0, 4_000_000, 1)
    text = b" ".join(b"w%d" % (i * i % 100_003) for i in range(2_500_000))
    assert runs.row_of(None, text)[1:5] == (1, 0, 2_500_000, 100_003)
    assert runs.row_of(None, b"x" * 20_000_000)[1] == 0
