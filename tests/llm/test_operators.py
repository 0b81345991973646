"""Each operator against DuckDB, a library or brute force, whole tables of the smallest size and hand-made cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as tokenizer_files
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import bpe, chunks, common, counts, exact, golomb, idfile, langid, mixing, neardup, pfor, quality, queries, repeats, secrets, shingles, suffixes

from ..oracle import same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
RANKS, JSON = tokenizer_files.path("byte_bpe_multi_50k.tiktoken"), tokenizer_files.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, body string, words string, kept string, most string, part long, th long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

CASES = [
    (1, "same text here", "en", "s"), (2, "same text here", "en", None), (None, "same text here", None, "s"), (3, None, "en", "s"), (4, "", None, None),
    (4, "", None, None), (5, "x" * 5000, "de", "t"), (6, " \t\n ", "fr", "t"), (7, "word " * 3000, "en", "s"), (8, "é中😀\x00 'll <|endoftext|>", "fr", "s"),
]


@pytest.fixture(scope="module")
def hand(spark):
    common.prepared(spark)
    return spark.createDataFrame([(*c, "a", "b", "c", "d", "e", 9, 9) for c in CASES], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    common.prepared(spark)
    return {r.doc_id: r.text or "" for r in common.documents(spark, SF).select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_duckdb(spark, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def test_quality_keeps_columns_and_handles_odd_rows(spark, hand):
    judged = quality.ledger(hand)
    got = {(r.doc_id, r.text): r for r in judged.select("doc_id", "text", "failed_bits", *quality.MEASURES).collect()}
    assert got[(3, None)].failed_bits & 1 and got[(6, " \t\n ")].n_words == 0
    assert got[(7, "word " * 3000)].n_repeat_words == 3000
    kept = quality.quality_filter(hand)
    assert kept.columns == hand.columns and quality.quality_filter(hand.limit(0)).count() == 0
    rules = {r.rule: r for r in quality.ablations(judged, quality.STRICT).collect()}
    assert rules["too_short"].n_failed == 9 and rules["repeated_windows"].n_failed == 1


def test_quality_holds_lines_against_lines(spark):
    rnd = random.Random(2)
    line = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(10))
    lines = [line() for _ in range(55)] + [line()] * 45
    han = " ".join("汉字没有空格所以词长很大" + chr(0x4E00 + i) for i in range(60))
    texts = {1: "\n".join(lines), 2: "\n".join(lines[:56]), 3: " ".join("x" * 12 + str(i) for i in range(100, 160)), 4: han}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert [r.doc_id for r in quality.quality_filter(docs).orderBy("doc_id").collect()] == [2, 4]


def test_repeat_words_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    got = {r.doc_id: r.n_repeat_words for r in quality.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = t.split()
        n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        assert got[i] == len({k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)})


def test_mixing(spark, hand):
    out = mixing.mix(hand, {"lang": {"en": 1, "fr": 1}})
    assert out.count() == len(CASES) and out.filter("probability < 0 or probability > 1 or probability is null").isEmpty()
    assert mixing.sample(hand).columns == hand.columns and mixing.sample(hand.limit(0)).count() == 0 and mixing.mix(hand.limit(0)).count() == 0
    # Columns named like added ones are replaced; the rest stays.
    clash = hand.withColumns({c: F.lit("x") for c in ("probability", "ratio", "n_tokens", "m_topic", "kept", "copies", "doc")})
    got = mixing.mix(clash)
    assert sorted(got.columns) == sorted({*hand.columns, "doc", *mixing.ADDED}) and dict(got.dtypes)["probability"] == "double"
    assert mixing.sample(clash).columns == clash.columns
    bare = spark.createDataFrame([(None, None, None, None), (1, "", None, "s")], "doc_id long, text string, lang string, source string")
    assert [(r.probability, r.copies, r.kept) for r in mixing.mix(bare).collect()] == [(1.0, 1, True)] * 2


WANTED = {"lang": {"en": 0.7, "es": 0.3}, "source": {"large": 0.8, "small": 0.2}, "topic": {"prose": 0.75, "figures": 0.25}}


def test_mixing_takes_the_target_shares(spark):
    rows = [(i, "word " * 20 + ("1234" if i % 10 == 0 else ""), "es" if i % 8 == 0 else "en", "small" if i % 25 == 0 else "large") for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(docs, WANTED).cache()
    assert abs(sum(r.n_tokens * r.copies for r in mixed.collect()) / (20 * 20000 + 2000) - 1) < 0.05
    for copies in (False, True):
        n = mixed.agg(F.sum("copies" if copies else F.col("kept").cast("long"))).first()[0]
        for r in mixing.achieved(mixed, copies).collect():
            share = WANTED[r.margin][r.value]
            assert abs(r.achieved - share) < 4 * (share * (1 - share) / n) ** 0.5 < 0.05, (copies, r)


def test_mixing_of_the_tables_reaches_tempered_shares(spark):
    mixed = mixing.mix(common.documents(spark, "/root/testdata/sf0.1")).cache()
    rows = mixing.achieved(mixed).collect()
    for m in mixing.MARGINS:
        own = [r for r in rows if r.margin == m]
        whole = sum(r.observed**mixing.TEMPER for r in own)
        for r in own:
            assert abs(r.achieved - r.observed**mixing.TEMPER / whole) < 0.01, r
    cells = mixed.groupBy(*mixing.KEYS).agg(F.sum("n_tokens").alias("tokens"))
    assert mixing.rake(cells).agg(F.max("residual")).first()[0] < 1e-9


def test_exact(spark, hand):
    got = {(r.doc_id, r.text_sha256): r for r in exact.duplicates(hand).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[(1, sha("same text here"))].keep_id == 2 and got[(None, sha("same text here"))].group_size == 3
    assert got[(3, sha(""))].keep_id == 4 and got[(4, sha(""))].kept and exact.duplicates(hand.limit(0)).count() == 0
    left = exact.drop_duplicates(hand)
    assert left.columns == hand.columns and sorted(r.doc_id for r in left.select("doc_id").collect()) == [2, 4, 4, 5, 6, 7, 8]


def test_rows_that_repeat_wholly_go_too(spark, hand):
    left = corpus_pipeline.exact_dedup(spark, hand.union(hand), SF)
    assert left.columns == hand.columns and sorted(r.doc_id for r in left.select("doc_id").collect()) == [2, 4, 5, 6, 7, 8]


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_golomb(n):
    v = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    assert (golomb.decode(n, *golomb.encode(v)) == v).all()


def test_language_accuracy_on_held_out(spark):
    got = queries.queries()["op4_language_id"](spark, SF).join(common.documents(spark, SF).select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()


def test_language_against_a_plain_recomputation(spark):
    """Counts, matrix and scores anew, n-gram by n-gram, for every document of the table."""
    from marketloom.llm.langid import BUCKETS, ORDERS, SMOOTHING

    rows = common.documents(spark, SF).select("doc_id", "text", "lang").collect()
    mask = (1 << 64) - 1

    def bucket(gram):
        acc = 0
        for n, c in enumerate(gram, 1):
            acc = acc * 0x9E3779B97F4A7C15 + ord(c) + n & mask
        h = acc * 0xD6E8FEB86659FD93 & mask
        return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & mask) >> 40

    def found(text):
        low = text.lower()
        return Counter(bucket(low[i : i + n]) % BUCKETS for n in ORDERS for i in range(len(low) - n + 1))

    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    counts, docs = {}, Counter()
    for r in rows:
        if r.text is not None and r.lang is not None and not held[r.doc_id]:
            counts.setdefault(r.lang, Counter()).update(found(r.text))
            docs[r.lang] += 1
    names = sorted(counts)
    logs = {x: np.log((np.array([counts[x][b] for b in range(BUCKETS)]) + SMOOTHING) / (sum(counts[x].values()) + SMOOTHING * BUCKETS)) for x in names}
    for r in queries.queries()["op4_language_id"](spark, SF).join(common.documents(spark, SF).select("doc_id", "text"), "doc_id").collect():
        assert r.held_out == held[r.doc_id]
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        grams = found(r.text)
        total = np.array([np.log(docs[x] / sum(docs.values())) + sum(logs[x][b] * n for b, n in grams.items()) for x in names])
        assert r.lang_pred == names[int(total.argmax())]
        assert abs(r.score - 1 / np.exp(np.minimum(0, total - total.max())).sum()) < 1e-3


def test_language_odd_rows(spark, hand):
    model = langid.train(hand)
    out = {r.doc_id: r for r in langid.predict(hand, model, ("doc_id", "kept")).collect()}
    assert out[3].lang_pred == "und" and out[6].lang_pred == "und" and out[5].lang_pred == "de" and 0 <= out[5].score <= 1 and out[5].kept == "d"
    assert {r.lang_pred for r in langid.predict(hand, langid.train(hand.limit(0))).collect()} == {"und"}


def test_language_scores_do_not_depend_on_slices(spark, hand, monkeypatch):
    whole = list(langid._sparse(["abc" * 50, "x"], 64))
    monkeypatch.setattr(langid, "PIECE", 20)
    cut = list(langid._sparse(["abc" * 50, "x"], 64))
    count = lambda parts: Counter((r, b) for rows, buckets in parts for r, b in zip(rows.tolist(), buckets.tolist()))
    assert count(whole) == count(cut)


def test_bpe_as_the_library(spark, texts, hand):
    import tiktoken

    lib = tiktoken.Encoding("t", pat_str=tokenizer_files.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})
    for r in queries.queries()["op5_byte_bpe"](spark, SF).collect():
        ids, text = lib.encode_ordinary(texts[r.doc_id]), texts[r.doc_id].encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
    got = bpe.decode(bpe.encode(hand, RANKS), RANKS).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t, _, _ in CASES)
    assert sorted(map(list, (r.ids for r in got))) == sorted(lib.encode_ordinary(t or "") for _, t, _, _ in CASES)
    assert bpe.encode(hand.limit(0), RANKS).count() == 0


def test_counts_and_files_as_the_library(spark, texts, hand, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    at = 0
    n = {r.doc_id: r for r in queries.queries()["op6_token_counts"](spark, SF).collect()}
    for r in queries.queries()["op7_id_files"](spark, SF).orderBy("doc_id").collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (n[r.doc_id].n_tokens, n[r.doc_id].n_bytes) == (len(ids) - 1, len(texts[r.doc_id].encode()))
        at += len(ids)
    got = counts.token_counts(hand, JSON, ("doc_id", "kept")).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, _, _ in CASES)
    idfile.write(hand.limit(0), f"file://{tmp_path}/none", JSON)
    assert idfile.read_documents(spark, f"file://{tmp_path}/none").count() == 0
    # Null ids come first, rows that share one by text; null and empty texts hold the end id alone.
    idfile.write(hand, f"file://{tmp_path}/hand", JSON)
    rows = sorted(((c[0], c[1] or "") for c in CASES), key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for d, t in rows:
        n = len(lib.encode(t, add_special_tokens=False).ids) + 1
        want.append((d, at, n))
        at += n
    assert [(r.doc_id, r.start, r.n_tokens) for r in idfile.read_documents(spark, f"file://{tmp_path}/hand").orderBy("start").collect()] == want


def test_rows_of_one_id_are_dealt_to_many_files(spark, tmp_path):
    """A third of all rows, or all, may have one id: they are split, and still numbered in one order."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    same_head = "h" * idfile.HEAD
    rows = [(i if i % 3 else None, f"{i} text") for i in range(300)] + [(500, f"{same_head}{i}") for i in range(300)] + [(600, "equal")] * 50
    idfile.write(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/hot", JSON)
    parts = spark.read.parquet(f"file://{tmp_path}/hot").select("part", F.explode("doc_ids").alias("d"))
    spread = {r.d: r.n for r in parts.groupBy("d").agg(F.countDistinct("part").alias("n")).filter("n > 1").collect()}
    assert 500 in spread and 600 not in spread
    got = idfile.read_documents(spark, f"file://{tmp_path}/hot").orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((d or -1, zlib.crc32(np.array(lib.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())) for d, t in rows)
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == want


def test_chunks_join_to_the_whole():
    from tokenizers import Tokenizer

    lib, mine, rnd = Tokenizer.from_file(JSON), chunks.library_encoder(JSON), random.Random(2)
    parts = [" ", "  ", "a", "é", "\n", "\t", "'s", "'", "1", ".", "\x1c", "　", "<|endoftext|>", "\x85", "中", "​", "😀"]
    for _ in range(400):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert mine.encoded([t])[0].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_parts_of_long_texts_join_to_the_whole(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(chunks, "PART", 30)
    lib, mine, rnd = Tokenizer.from_file(JSON), chunks.library_encoder(JSON), random.Random(7)
    words = ["a", "bread", "é,", "  ", "\n", "x y", "<|endoftext|>", "中文", "1234", "'s", " ", "\u00a0z"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 90))) for _ in range(60)] + ["q" * 500, "", " "]
    ids, per = mine.encoded(texts)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and per.tolist() == [len(w) for w in want] == mine.lengths(texts).tolist()


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_words_of_long_texts(piece):
    rnd = np.random.default_rng(piece)
    data = np.frombuffer(b" \nabAB", np.uint8)[rnd.integers(0, 6, 900)]
    for d in (data, np.frombuffer(b"x" * 300, np.uint8), np.frombuffer(b"   ", np.uint8), np.frombuffer(b"ab ", np.uint8)):
        assert (shingles.long_word_hashes(d, piece) == shingles.word_hashes(np.array([0, len(d)]), d)[0]).all()


@pytest.mark.parametrize("kind", ["words", "one word"])
def test_memory_does_not_grow_with_a_long_text(kind):
    """A text of 20 MB: what the operators hold beside it and its result stays under three of their slices' worth of arrays."""
    import tracemalloc

    import pyarrow as pa

    size = 20 << 20
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 123, size).astype(np.uint8)
    if kind == "words":
        data[rnd.integers(0, size, size // 6)] = 32
    text = data.tobytes().decode()
    batch = pa.record_batch({"doc_id": [1], "th": [2], "text": pa.array([text])})
    tracemalloc.start()
    n = sum(b.num_rows for b in repeats._find(iter([batch])))
    assert n > size // 300 and tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.reset_peak()
    words = shingles.long_word_hashes(data)
    assert tracemalloc.get_traced_memory()[1] - words.nbytes < 200 << 20 and len(words) == len(text.split())
    tracemalloc.stop()
    if kind == "words":
        mine = chunks.ChunkEncoder(lambda texts: [[1] for _ in texts])
        tracemalloc.start()
        mine.lengths([text[: 4 << 20]])
        assert tracemalloc.get_traced_memory()[1] < 300 << 20
        tracemalloc.stop()


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("high", [1, 2, 50000, 1 << 32])
def test_blocks(n, high):
    v = np.random.default_rng(n).integers(0, high, n).astype(np.uint32)
    v[::17] = np.random.default_rng(1).integers(0, 1 << 32, len(v[::17]))
    data = pfor.pack(v)
    assert (pfor.unpack(data) == v).all() and (pfor.unpack(data, 77, 300) == v[77:300]).all()


def spans(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, t) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets_base_spans(spark, texts):
    for r in queries.queries()["op8_secret_scan"](spark, SF).collect():
        assert r.base_sha256 == hashlib.sha256(spans(texts[r.doc_id]).encode()).hexdigest()


def test_secrets_link_parts_only_together(spark, hand):
    key, value, far = "AKIA" + "Q" * 12 + "7", "Zm9vYmFyYmF6cXV4" * 2 + "x", " filler" * 60
    rows = [(1, f"é {key} and {value}"), (2, key + far + value), (3, value), (4, f"{key} at https://s3.example.org"), (4, f"{key} at https://s3.example.org"), (5, "token: password = abcdefghijklmnop"), (6, None)]
    got = {r.doc_id: r.all for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secrets.listed("spans").alias("all")).collect()}
    assert got[1] == f"key_id:2:19,key_value:24:{24 + len(value)}" and got[2] == "" and got[3] == ""
    assert got[4] == "key_id:0:17,endpoint:21:43" and got[5] == "" and got[6] == ""
    clash = hand.withColumns({c: F.lit("x") for c in ("base", "spans", "weak", "links", "row_key", "doc")})
    out = secrets.find_secrets(clash)
    assert sorted(out.columns) == sorted({*clash.columns} - {"text"}) and out.count() == len(CASES) and out.filter("body <> 'b' or links <> 'x' or size(spans) > 0").isEmpty()
    assert secrets.find_secrets(hand.limit(0)).count() == 0


def groups(rows, k, threshold=80):
    """Components by comparing all pairs."""
    low = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= threshold * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates_against_all_pairs(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.queries()["op9_near_duplicates"](spark, SF).collect()}
    assert got == groups(texts.items(), 4)


@pytest.mark.parametrize("bound, value", [("FAMILY", 40), ("SHINGLES", 4000)])
def test_near_duplicates_of_one_large_ambiguous_group(spark, monkeypatch, bound, value):
    """Many copies of one text with edits: similarities on both sides of the bound, families cut into blocks."""
    monkeypatch.setattr(neardup, bound, value)
    rnd, base = random.Random(4), [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 7)):
            w[rnd.randrange(len(w))] = f"z{rnd.random()}"
        rows.append((d, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    want = groups(rows, 4)
    assert {d: n for d, (n, _) in got.items()} == {d: n for d, (n, _) in want.items()} and got == want


def test_near_duplicates_odd_rows(spark, hand):
    got = neardup.near_duplicates(hand).collect()
    assert len(got) == len(CASES) and {r.component_id for r in got if r.doc_id in (1, 2)} == {1} and all(r.kept for r in got if r.doc_id is None)
    assert neardup.drop_near_duplicates(hand).columns == hand.columns and neardup.near_duplicates(hand.limit(0)).count() == 0


def repeated(rows, length=400):
    n = Counter(hash(t[p : p + length]) for t in rows for p in range(len(t) - length + 1))
    for t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if n[hash(t[p : p + length])] > 1:
                gone[p : p + length] = True
        yield len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()


def test_repeats_against_all_strings(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.queries()["op10_suffix_dedup"](spark, SF).collect()}
    assert got == dict(zip(texts, repeated([t.encode() for t in texts.values()])))


def test_repeats_at_edges(spark, monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", 5000)  # several sorted runs
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = word(1500)
    rows = [word(200) + shared[a : a + n] + word(150) for a, n in ((0, 399), (0, 400), (3, 401), (100, 900), (350, 1100), (0, 1500), (600, 420))]
    rows += ["xy" * 600, "q" * 401, "z" * 400, word(399), "", word(100) + "éa" * 300]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    for d, (n, gone, parts, sha) in enumerate(repeated([t.encode() for t in rows])):
        s = out[d].spans or []
        assert (out[d].n_bytes, sum(x.hi - x.lo for x in s), len(s), hashlib.sha256(bytes(out[d].kept)).hexdigest()) == (n, gone, parts, sha), d


def same_as_all_strings(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    for d, (n, gone, parts, sha) in enumerate(repeated([t.encode() for t in rows])):
        s = out[d].spans or []
        assert (out[d].n_bytes, sum(x.hi - x.lo for x in s), len(s), hashlib.sha256(bytes(out[d].kept)).hexdigest()) == (n, gone, parts, sha), d


def test_repeats_of_a_hot_gram_are_split(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 4)
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = word(900)
    rows = [word(rnd.randint(100, 500)) + shared[rnd.randint(0, 300) : rnd.randint(500, 900)] + word(rnd.randint(100, 500)) for _ in range(60)]
    same_as_all_strings(spark, rows + [rows[0], rows[0], "q" * 700, "q" * 500])


def test_repeats_in_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 700)
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = word(800)
    same_as_all_strings(spark, [word(3000) + shared + word(2500) + shared[:450] + word(900), word(700) + shared[100:], word(5000)])


def test_no_text_goes_by_a_collision(spark):
    """Thue-Morse runs collide under polynomials modulo 2^64 with any odd base: these two texts share no string of 400 bytes."""
    morse = lambda a, b: "".join((a, b)[bin(i).count("1") & 1] for i in range(256))
    gram = "".join(random.Random(3).choice("abcdef") for _ in range(128))
    rows = [morse("0", "O") + gram + morse("0", "O"), morse("O", "0") + gram + morse("O", "0")]
    out = repeats.remove_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert all(r.spans is None and bytes(r.kept).decode() == rows[r.doc_id] for r in out)


@pytest.mark.parametrize("length", [1, 5, 40])
def test_suffixes_in_order_of_their_bytes(length):
    rnd = np.random.default_rng(length)
    data = rnd.integers(97, 99, 600).astype(np.uint8)
    data[300:500] = data[:200]
    start = rnd.permutation(600 - length)
    first, size = np.zeros(len(start), np.int64), np.full(len(start), len(start))
    order = suffixes.merge_sorted(suffixes.Text(data), start, first, size, length)
    got = [data[s : s + length].tobytes() for s in start[order]]
    assert got == sorted(got)
    n = Counter(got)
    assert set(start[suffixes.repeating(data, start, np.zeros(len(start), np.int64), length)]) == {s for s in start if n[data[s : s + length].tobytes()] > 1}


def test_bytes_decide_where_hashes_collide(monkeypatch):
    monkeypatch.setattr(suffixes.Text, "same", lambda self, a, b, length: np.ones(len(a), bool))
    data = np.frombuffer(b"abcdabceabcd", np.uint8)
    assert suffixes.repeating(data, np.array([0, 4, 8]), np.zeros(3, np.int64), 4).tolist() == [0, 2]


def test_products_modulo_the_prime():
    rnd = random.Random(1)
    a, b = ([rnd.randrange(suffixes.PRIME) for _ in range(500)] + [suffixes.PRIME - 1, 0, 1] for _ in range(2))
    assert suffixes.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % suffixes.PRIME for x, y in zip(a, b)]


def test_repeats_odd_rows(spark, hand):
    got = {(r.doc_id, bytes(r.kept)): r.spans for r in repeats.remove_repeats(hand).collect()}
    assert len(got) == len({(c[0], c[1] or "") for c in CASES}) and got[(5, b"")][0].hi == 5000 and got[(7, b"")][0].hi == 15000 and got[(3, b"")] is None
    assert repeats.remove_repeats(hand.limit(0)).count() == 0


def test_weak_part_is_not_its_own_counterpart(spark):
    both = "AKQ7ZP2M" * 4
    docs = spark.createDataFrame([(1, f"see {both} here"), (2, f"see {both} and {both} here")], "doc_id long, text string")
    scanned = secrets.scan(docs).select("doc.doc_id", "base", "weak")
    weak = {r.doc_id: {x.k for x in r.weak} for r in scanned.collect()}
    assert len(weak[1]) == 2
    links = {r.doc_id: len(r.links) for r in secrets.linked(scanned, "doc_id").collect()}
    assert links == {2: 4}
