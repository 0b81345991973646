"""SimHash fingerprints and their links against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from marketloom.llm import common, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "a b c"), (8, "a  b\tc"), (9, "é中😀 \x85x b A b a"), (9, "another text of the same id"),
    (None, "a b c"), (None, "no other row has this text"), (10, "x" * 5000), (11, "word " * 3000), (12, "a b c d " * 40), (12, "a b c d " * 40),
]


def plain(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    rows = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in rows]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def components(prints):
    """fingerprint -> representative, by all pairs."""
    up = {p: p for p in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    every = sorted(up)
    array = np.array(every, np.uint64)
    for i, p in enumerate(every):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 2):
            up[top(every[i + 1 + j])] = top(p)
    return {p: top(p) for p in every}


def expected(rows):
    """(doc_id, fingerprint, component_id) of every row."""
    prints = [plain(t) for _, t in rows]
    tops, least = components(prints), {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[tops[p]] = min(d, least.get(tops[p], d))
    return sorted(((d, f"{p:016x}", least.get(tops[p])) for (d, _), p in zip(rows, prints)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def varied(seed=3):
    """Long texts with copies in which a word or two differ, so that some fingerprints are near."""
    rnd = random.Random(seed)
    rows = []
    for i in range(12):
        words = [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(400)]
        for k in range(8):
            own = list(words)
            for _ in range(k):
                own[rnd.randrange(400)] = "zz"
            rows.append((i * 10 + k, " ".join(own)))
    return rows


@pytest.mark.parametrize("paired", [simhash.PAIRED, 1])
def test_against_all_pairs(spark, paired):
    common.prepared(spark)
    rows = ODD + varied()
    want = expected(rows)
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want}), "no links in the data"
    wide = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, print string, start int, component_id int")
    assert got(simhash.near_duplicates(wide, paired=paired)) == want
    assert got(simhash.near_duplicates(wide.limit(0))) == []


def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in common.documents(spark, SF).collect()]
    assert got(simhash.query(common.prepared(spark), SF)) == expected(docs)


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("paired", [1 << 20, 8, 1])
def test_links_join_what_all_pairs_join(spark, distance, paired):
    rnd = random.Random(distance)
    prints = {rnd.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:120]:  # neighbours at 1 to 3 bits, in every place of the ring
        prints.add(p ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3))))
    one = rnd.getrandbits(64)  # a family that shares its head, so that its buckets are large
    prints |= {one ^ sum(1 << b for b in rnd.sample(range(0, 38), rnd.randint(0, 3))) for _ in range(200)}
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    found = simhash.links(spark.createDataFrame(signed, "print long"), distance, paired).collect()
    up = {p: p for (p,) in signed}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        up[max(top(a), top(b))] = min(top(a), top(b))
    every = np.array([p for (p,) in signed], np.int64)
    for i, a in enumerate(every):
        for b in every[i + 1 :][np.bitwise_count((every[i + 1 :] ^ a).view(np.uint64)) <= distance]:
            assert top(int(a)) == top(int(b))
    near = {(min(a, b), max(a, b)) for a, b in found}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b in near)


@pytest.mark.parametrize("piece", [7, 64, 1000])
def test_long_texts_go_piece_by_piece(piece):
    texts = [t or "" for _, t in ODD] + [t for _, t in varied()[:3]]
    out = np.concatenate([p for _, p in simhash.fingerprints_of(pa.array(texts), piece=piece)])
    assert out.tolist() == [plain(t) for t in texts]


def test_a_text_of_twenty_megabytes(spark):
    text = "Some words that go on, and on " * 700_000
    rows = spark.createDataFrame([(1, text), (2, text + " end"), (3, "y" * 20_000_000)], "doc_id long, text string")
    a, b, c = simhash.near_duplicates(rows).orderBy("doc_id").collect()
    assert a.component_id == b.component_id == 1 and c.fingerprint == f"{xxhash.xxh64_intdigest(b'y' * 20_000_000, 42):016x}"
