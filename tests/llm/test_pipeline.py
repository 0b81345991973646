import os
import re
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import bpe, common, mixing
from public_tokenizers import PATTERN

from .test_operators import groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_against_brute_force(spark):
    docs = common.documents(common.prepared(spark), SF)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = common.stored(stage(spark, docs, SF), name)
        if name == "encode_bytes":
            lib = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.ranks_of(corpus_pipeline.RANKS), special_tokens={})
            assert {r.doc_id: list(r.ids) for r in docs.collect()} == {d: lib.encode_ordinary(t) for d, t in before.items()}
            continue
        assert docs.columns == columns
        seen[name] = (before, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    before, after = seen["quality_rules"]
    assert set(after) == {d for d, t in before.items() if good(t or "")} and len(after) > 0.7 * len(before)
    before, after = seen["exact_dedup"]
    last = {}
    for d, t in before.items():
        last[t] = max(d, last.get(t, d))
    assert set(after) == set(last.values())
    before, after = seen["near_dedup"]
    assert set(after) == {d for d, (_, c) in groups(before.items(), 5).items() if c == d}
    before, after = seen["mix_sources"]
    assert set(after) <= set(before) and all(before[d] == t for d, t in after.items())


def good(text):
    """The rules of policy 3 in plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(words), sum(map(len, words))
    windows = Counter(zip(words, words[1:], words[2:]))
    repeats = {i + k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    twice = len(lines) - len(set(lines))
    symbols = sum(c in "#*$%&|<>" for c in text)
    unspaced = sum("\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" for c in text)
    return not (
        n < 50 or 100 * len(repeats) > 50 * n or 10 * symbols > 3 * n or chars > 40 * n or 2 * twice > n or 10 * twice > 3 * len(lines) or (chars > 10 * n and 10 * unspaced < chars)
    )


def test_mix_stage_takes_tempered_shares(spark):
    docs = common.documents(common.prepared(spark), "/root/testdata/sf0.01")
    taken = mixing.with_cells(corpus_pipeline.mix_sources(spark, docs, "")).cache()
    given = mixing.with_cells(docs).cache()
    n = taken.count()
    for m in ("m_lang", "m_topic"):
        had, got = ({r[0]: r[1] for r in df.groupBy(m).agg({"n_tokens": "sum"}).collect()} for df in (given, taken))
        whole, want = sum(got.values()), sum(x**mixing.TEMPER for x in had.values())
        for value, tokens in had.items():
            share = tokens**mixing.TEMPER / want
            # Documents differ in length, so shares of tokens vary more than those of as many equal documents.
            assert abs(got[value] / whole - share) < 8 * (share * (1 - share) / n) ** 0.5, value


ODD = [
    (1, None, None, None), (None, "some words " * 40, "en", "s"), (2, "", "", ""), (2, "", "", ""), (3, "many different words " + " ".join(f"w{i}" for i in range(200)), None, "s"),
    (4, " ".join(f"long{i}" for i in range(300_000)), "fr", None), (5, "tie " + " ".join(f"t{i}" for i in range(80)), "en", "s"), (5, "tie " + " ".join(f"t{i}" for i in range(80)), "en", "s"),
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows_and_clashing_columns(spark, name, stage):
    extra = {c: "x" for c in ("n_words", "failed_bits", "kept", "component_id", "v", "gone", "suspect", "probability", "ratio", "copies", "n_tokens", "doc", "ids", "_ledger", "body")}
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumns({k: F.lit(v) for k, v in extra.items()})
    common.prepared(spark)
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    ids = sorted((r.doc_id for r in rows), key=str)
    if name == "encode_bytes":
        assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
        return
    assert out.columns == docs.columns and {r.probability for r in rows} <= {"x"}
    want = {
        "quality_rules": [3, 4, 5, 5], "exact_dedup": [2, 3, 4, 5, None], "near_dedup": [1, 2, 2, 3, 4, 5, 5, None],
    }
    assert ids == sorted(want.get(name, ids), key=str)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    # What stages before the last have stored on their way is gone, and the result does not need it.
    assert not [n for n in os.listdir(common.shared_dir(spark).removeprefix("file://").removeprefix("file:")) if n.startswith("passing-")]
    assert out.filter("n_tokens > 0").count() > 0
