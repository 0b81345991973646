"""Quality rules as a ledger of failure bits: measure once, judge by versioned policies afterwards.

``ledger`` evaluates every rule once per document and stores the measurements beside one long with
a bit for each failed rule. A ``Policy`` is a version and a set of rules; applying it is one bitwise
AND, so policies change without reading a text again. ``ablations`` counts what each rule of a
policy rejects alone, from the counts of the distinct bit patterns.

Everything is a Column expression. Word windows are compared within their own row by sorting, in
n log n time: nothing is exploded, so there is no shuffle however long or repetitive a text is.

Cases: a null or empty text has no words and fails the length rule; rows that repeat are judged
each for itself; other columns of the input stay, and a column named like a measurement is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Measurements, in order, over ``t.words`` and ``t.body`` (the text, null as empty).
MEASURES = {
    "n_words": "bigint(size(t.words))",
    "word_chars": "bigint(length(array_join(t.words, '')))",
    "n_symbols": f"bigint(length(t.body) - length(translate(t.body, '{SYMBOLS}', '')))",
    "n_dup_lines": r"""bigint(transform(array(filter(split(t.body, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')),
        x -> size(x) - size(array_distinct(x)))[0])""",
    # Windows of three words sorted by hash: equal ones are neighbours, and their words are compared as well.
    # The starts of repeated windows in order then tell how many words they cover together.
    "n_repeat_words": """bigint(if(size(t.words) < 4, 0, transform(array(sort_array(
        transform(sequence(0, greatest(size(t.words) - 3, 0)), i ->
            struct(xxhash64(t.words[i], get(t.words, i + 1), get(t.words, i + 2)) as h, i as i)))), s ->
        aggregate(sort_array(filter(transform(s, (x, k) -> if(
                (x.h = get(s, k - 1).h and t.words[x.i] = t.words[get(s, k - 1).i]
                    and t.words[x.i + 1] = t.words[get(s, k - 1).i + 1] and t.words[x.i + 2] = t.words[get(s, k - 1).i + 2])
                or (x.h = get(s, k + 1).h and t.words[x.i] = t.words[get(s, k + 1).i]
                    and t.words[x.i + 1] = t.words[get(s, k + 1).i + 1] and t.words[x.i + 2] = t.words[get(s, k + 1).i + 2]),
            x.i, null)), i -> i is not null)),
            struct(-3 as last, 0 as n), (a, i) -> struct(i as last, a.n + least(3, i - a.last) as n), a -> a.n))[0]))""",
}

#: Letters of scripts that put no space between words: Thai to Lao, Burmese, Khmer, kana and Han.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}"

#: Those and what the rules on whole lines and mean words need besides.
LINE_MEASURES = MEASURES | {
    "n_lines": r"""bigint(size(filter(split(t.body, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')))""",
    "n_unspaced": f"bigint(length(t.body) - length(regexp_replace(t.body, r'[{UNSPACED}]', '')))",
}


@dataclass(frozen=True)
class Rule:
    """A document fails when ``fails`` (SQL over the measurements) is true. ``bit`` is never reused."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "too_short", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_heavy", "10 * n_symbols > 3 * n_words"),
    Rule(3, "long_words", "word_chars > 40 * n_words"),
    Rule(4, "repeated_lines", "2 * n_dup_lines > n_words"),
)
BASE = Policy("base", ("too_short", "repeated_windows"))
STRICT = Policy("2", ("too_short", "repeated_windows", "symbol_heavy", "long_words", "repeated_lines"))

#: Lines are held against lines, and the mean word against a length that occurs, unspaced scripts aside.
LINE_RULES = (
    *RULES,
    Rule(5, "duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(6, "long_mean_word", "word_chars > 10 * n_words and 10 * n_unspaced < word_chars"),
)
LINES = Policy("3", (*STRICT.rules, "duplicate_lines", "long_mean_word"))


def mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in policy.rules)


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, measures: Mapping[str, str] = MEASURES) -> DataFrame:
    """docs with the measurements and ``failed_bits`` (long, bit r.bit set if rule r fails)."""
    for r in rules:
        if not 0 <= r.bit < 63:
            raise ValueError(f"bit {r.bit} of {r.name} is outside 0..62")
    # One expression, with words and measurements bound once: as stacked columns, a filter that Catalyst pushes down
    # would split the text again wherever words are looked at.
    words = f"transform(array(coalesce(text, '')), b -> struct(b as body, filter(split(b, r'{SPACE}', -1), w -> w <> '') as words))"
    measured = f"transform({words}, t -> struct({', '.join(f'{v} as {k}' for k, v in measures.items())}))"
    bit = [f"if({re.sub(r'(' + '|'.join(measures) + r')', r'm.\1', r.fails)}, {1 << r.bit}L, 0L)" for r in rules]
    judged = f"transform({measured}, m -> struct({', '.join(f'm.{k} as {k}' for k in measures)}, {' | '.join(bit or ['0L'])} as failed_bits))[0]"
    kept = [c for c in docs.columns if c not in (*measures, "failed_bits")]
    return docs.withColumn("_ledger", F.expr(judged)).select(*kept, "_ledger.*")


def passes(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablations(judged: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of the policy: documents it fails, and those kept only if it were left out.

    The ledger is first counted by bit pattern (map-side, at most 2^rules rows); every rule then reads
    only those counts.
    """
    own = [r for r in rules if r.name in policy.rules]
    m = mask(policy, rules)
    counts = judged.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in own]))
    return (
        counts.withColumn("r", rule)
        .groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def quality_filter(docs: DataFrame, policy: Policy = LINES) -> DataFrame:
    """The documents that pass the policy, with the columns they came with."""
    judged = ledger(docs.select(F.struct("*").alias("doc"), "text"), LINE_RULES, LINE_MEASURES)
    return judged.filter(passes(policy, LINE_RULES)).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ledger(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    return judged.withColumns({"base_failed": ~passes(BASE), "kept": passes(STRICT)}).select(
        "doc_id", *MEASURES, "base_failed", "kept", "failed_bits"
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
  FROM d, unnest(generate_series(1, len(w) - 2)) AS t(i)
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) AS v(k) WHERE c > 1 GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_words THEN 16 ELSE 0 END)::BIGINT AS failed_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""
