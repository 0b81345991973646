"""The trie of conversation prefixes against a plain one."""

import hashlib
import random
import zlib

import pytest

from marketloom.llm import common, trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Every node of the trie, from plain lists."""
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0, r, digest(r, t)), (r, t)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        line = tuple(base[:h] + turns[h:])
        for d in range(len(line) + 1):
            nodes.setdefault(line[:d], []).append((c, d == len(line)))
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = sum(1 for k in below if not any(len(j) == len(k) + 1 and j[: len(k)] == k for j in below))
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(map(str, sorted(c for c, e in members if e)))
        parent = min(c for c, _ in nodes[key[:-1]]) if key else None
        out.append((min(c for c, _ in members), len(key), parent, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def conversations(seed, n=60, depth=9, said="ab"):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(0, 400), n):
        for t in range(rnd.randint(1, depth)):
            rows.append((c, t, rnd.choice(["user", "bot"]) if t > 2 else "user", rnd.choice(said) * rnd.randint(1, 2)))
    return rows


@pytest.mark.parametrize("band,ranges,packed", [(16, None, 1 << 14), (2, 3, 1), (3, 7, 2)])
def test_against_plain_lists(spark, monkeypatch, band, ranges, packed):
    common.prepared(spark)
    monkeypatch.setattr(trie, "PACKED", packed)
    rows = conversations(band)
    rows += [(c, k, "user", "one") for c in range(500, 540) for k in range(3)]  # the same conversation many times
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), band, ranges)) == plain(rows)


def test_long_conversations_over_many_ranges(spark):
    common.prepared(spark)
    rows = [(7, t, "user", "x" * (t % 3)) for t in range(200)] + [(100, t, "user", "x" * (t % 3)) for t in range(120)] + [(101, t, "user", "y") for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert got(trie.prefix_trie(df, 4, 9)) == want and max(r[1] for r in want) >= 195
    # More than one range holds nothing but turns of one conversation.
    assert len({r.part for r in _turns(df, 9) if r.conv_id == 7}) > 3


def _turns(df, ranges):
    found = []

    def held(rows, name, stored=trie.stored):
        found.append(stored(rows, name))
        return found[-1]

    before, trie.stored = trie.stored, held
    try:
        trie.ordered_prefixes(df, ranges)
    finally:
        trie.stored = before
    return found[0].collect()


def test_odd_rows(spark):
    common.prepared(spark)
    big = (1 << 63) - 1
    rows = [
        (None, 1, "user", "left out"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 2, "user", "é😀"), (1, 2, "user", "é😀"), (2, 5, "b", "x"), (2, 5, "a", "y"), (2, 5, "a", "x"),
        (0, 1, "user", "first"), (-5, 1, "user", "below zero"), (-105, 1, "user", "below zero"), (big, 1, "user", "z" * 5000), (300, 1, "user", "same"), (301, 1, "user", "same"), (302, 1, "user", "same"),
    ]
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", node long, digest string")
    assert got(trie.prefix_trie(wide)) == plain(rows)
    assert got(trie.prefix_trie(wide.limit(0))) == [] and trie.prefix_trie(wide.filter("conv_id is null")).count() == 0


def test_query_against_plain_lists(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert got(trie.query(common.prepared(spark), SF)) == plain(rows)
