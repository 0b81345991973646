"""The secret scan on long texts, and its patterns against the plain ones."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from marketloom.llm import common, secrets


def scanned(spark, text):
    common.prepared(spark)
    return secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))


def timed(df, most):
    began = time.time()
    row = df.select("base", "spans").first()
    assert time.time() - began < most
    return row


def test_chains_of_labels(spark):
    for text in ("http://x.y " + "a." * 20_000 + "a", "a.." * 20_000, "-" * 100_000 + ".", "x azure " + "amazonaws." * 20_000, "azure " + ".azure.a" * 20_000 + ".azure.net"):
        timed(scanned(spark, text), 30)
    assert timed(scanned(spark, "internal " + "a." * 20_000 + "azure.com" + "b" * 40_000 + " AKIA" + "X" * 20), 30)
    ends = scanned(spark, "a." * 20_000 + "azure.com and AKIA" + "X" * 20).select("spans").first().spans
    assert [(x.s, secrets.KINDS[x.k], x.e) for x in ends] == [(0, "endpoint", 40_009), (40_014, "access", 40_038), (40_014, "key_id", 40_038)]


def test_a_megabyte_of_hex(spark):
    row = timed(scanned(spark, "internal azure " + "0123456789abcdef" * 65_536), 60)
    assert [(x.s, x.k, x.e) for x in row.base] == [(15, 2, 15 + (1 << 20))]


def test_twenty_megabytes_of_hashes(spark):
    n = 600_000
    line = " ".join(hashlib.md5(str(i % 1000).encode()).hexdigest() for i in range(1000))
    text = " ".join([line] * (n // 1000))
    assert len(text) > 19_000_000
    df = scanned(spark, text)
    row = df.select(F.size("base").alias("n"), F.expr("base[599999].s").alias("s"), F.expr("exists(base, x -> x.e - x.s <> 32)").alias("odd"), F.size("spans").alias("all")).first()
    assert (row.n, row.s, row.odd, row.all) == (n, 33 * (n - 1), False, n)


@pytest.mark.parametrize("seed", range(4))
def test_hosts_are_those_of_the_plain_pattern(seed):
    rnd = random.Random(seed)
    one, plain = (re.compile(f"(?i:{secrets.ADDRESS}|{p})") for p in (secrets.HOST, secrets.PLAIN_HOST))
    bits = ["a", "b-", ".", ".", "..", "azure", "amazonaws", "internal", ".com", "net", " ", "http://", "https:", "//", "é", "_", "Azure.NETWORKING", "x.internal.io"]
    for _ in range(4000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14)))
        assert [m.span() for m in one.finditer(text)] == [m.span() for m in plain.finditer(text)], text


def test_many_matches_are_numbered_as_few_are(spark):
    common.prepared(spark)
    rnd = random.Random(1)
    words = ["password=" + "x" * 14, "AKIA" + "B" * 16, "0123456789abcdef0", "plain", "é😀", "https://a.b", "Q" * 20, "k" * 40]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(n))) for i, n in enumerate([0, 1, 5, 255, 256, 257, 600, 3000])]
    got = {r.doc_id: r.base for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = sorted((m.start(), k, m.end()) for k, (p, _, g, least) in enumerate(secrets.BASE.values()) for m in re.finditer(p, text) if len(m[g]) >= least)
        assert [(x.s, x.k, x.e) for x in got[i]] == want
