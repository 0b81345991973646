"""Mixing sources to target weights by iterative proportional fitting (raking), then sampling.

Tokens are summed by cell (source, language, topic) before anything else, so fitting works on a table of
cells, not of documents. Each pass scales the cells to one marginal after the other; passes end when what is left over on
every marginal (the residual) is small. A cell's ratio is its calibrated weight to its tokens. It is sampled in two ways, both by a hash
of the id, so that the same documents are taken on every run and on every cluster:

* ``probability``, the ratio over the largest ratio: the kept documents have the fitted marginals, and nothing is taken twice.
* ``copies``, the whole part of the ratio and one more with the probability of its fraction: about as many tokens as came in.

Documents differ much in length, so as many documents are not as many tokens. A cell's documents are therefore taken up to the cut
of the hash at which their tokens, summed by BINS ranges of the hash, come to the wanted part of the cell; in the mean that is the probability.

Targets are shares per value of a marginal. Without given ones they are the observed shares raised to ``TEMPER``, which
moves weight from large values to small ones.

Cases: null source or language is a value of its own; null or empty texts have no tokens and go with their cell; a
value without a target keeps its observed share; a target that no cell can serve (a value without tokens, margins that
contradict each other) stays as ``residual``, and is warned of; rows that share a doc_id have one fate within a cell; cells without tokens keep
all rows, once; columns of the input stay, but those named like an added one are replaced; very long texts are one row
like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, small_or_not, stored
from .quality import SPACE

MARGINS = ("source", "lang", "topic")
KEYS = [f"m_{m}" for m in MARGINS]
ADDED = ("n_tokens", *KEYS, "ratio", "probability", "copies", "kept", "residual")
#: The residual (of the total) at which passes end, and at most so many passes.
TOLERANCE, PASSES = 1e-12, 200
#: A pass that leaves more than this part of the residual has not lessened it.
STILL = 0.999
LARGEST = 1e60
#: Ranges of the hash whose tokens are summed for each cell.
BINS = 1024
#: A residual above this is warned of.
REPORTED = 1e-6
TEMPER = 0.7
SEED = 17

#: The topic is what a text is made of: rows of a table, prose with figures, or prose.
TOPIC = "CASE WHEN text LIKE '%|%|%' THEN 'table' WHEN text RLIKE '[0-9]{4}' THEN 'figures' ELSE 'prose' END"
#: Tokens are counted as words, unless the caller has counts.
TOKENS = f"bigint(size(filter(split(coalesce(text, ''), r'{SPACE}', -1), w -> w <> '')))"


def uniform(of: str = "doc_id", seed: int = SEED) -> Column:
    """A number in [0, 1) by the md5 of seed and value, that any engine can compute."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(of).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def with_cells(docs: DataFrame, topic: str = TOPIC, tokens: str = TOKENS) -> DataFrame:
    """docs with n_tokens and the three marginals as never-null ``m_`` columns. topic, tokens: SQL over the columns of docs."""
    null = F.lit("(none)")
    return docs.withColumns({
        "n_tokens": F.coalesce(F.expr(tokens).cast("long"), F.lit(0)), "m_source": F.coalesce(F.col("source"), null), "m_lang": F.coalesce(F.col("lang"), null),
        "m_topic": F.coalesce(F.expr(topic), F.lit("prose")),
    })


def _targets(cells: DataFrame, margin: str, given: Mapping[str, float] | None, total: float) -> DataFrame:
    """The values of a marginal, each with ``t``, the tokens that it should have, and a factor ``f`` of 1."""
    own = cells.groupBy(f"m_{margin}").agg(F.sum("tokens").cast("double").alias("own"))
    share = F.pow("own", F.lit(TEMPER))
    if given:
        wanted = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "value string, share double")
        own = own.join(wanted, own[f"m_{margin}"] == wanted["value"], "left")
        share = F.coalesce("share", F.col("own") / F.lit(total) if total else F.lit(0.0))
    own = stored(own.select(f"m_{margin}", share.alias("s")), "values")
    whole = own.agg(F.sum("s")).first()[0] or 0.0
    return own.select(f"m_{margin}", (F.col("s") / F.lit(whole) * F.lit(total) if whole else F.lit(0.0)).alias("t"), F.lit(1.0).alias("f"))


def _with_factors(cells: DataFrame, values: Mapping[str, DataFrame], sizes: Mapping[str, int], margins) -> DataFrame:
    """cells with f_source, f_lang or f_topic, by tables that are broadcast while their counted values are few."""
    for m in margins:
        cells = cells.join(small_or_not(values[m].select(f"m_{m}", F.col("f").alias(f"f_{m}")), sizes[m], 100), f"m_{m}")
    return cells


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """cells (m_source, m_lang, m_topic, tokens) with ``weight``: calibrated tokens, of the same total, and ``residual``: the largest
    difference of a marginal from its target, as a part of the total, in the last pass.

    A weight is the tokens times a factor for each of its three values. A step solves the factors of one marginal, given the other
    two: sums by value, combined in each task before they move. Cells never move, and no task has them all. Targets that contradict each other leave a residual that
    two passes do not lessen, or drive factors apart without end: the last ones within bounds stay.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    values = {m: _targets(cells, m, (targets or {}).get(m), total) for m in MARGINS}
    sizes = {m: v.count() for m, v in values.items()}
    residual, still = 0.0, 0
    for k in range(PASSES if total else 0):
        new, off, largest = dict(values), 0.0, 0.0
        for m in MARGINS:
            others = [x for x in MARGINS if x != m]
            n = F.col("tokens").cast("double") * F.col(f"f_{others[0]}") * F.col(f"f_{others[1]}")
            sums = _with_factors(cells, new, sizes, others).groupBy(f"m_{m}").agg(F.sum(n).alias("z"))
            solved = sums.join(small_or_not(new[m], sizes[m], 100), f"m_{m}").withColumn("to", F.when(F.col("z") > 0, F.col("t") / F.col("z")).otherwise(1.0))
            apart = F.when(F.col("to") > 0, F.abs(F.col("f") / F.col("to") - 1) * F.col("t")).otherwise(0.0)
            # One job a step: its table cuts the lineage, and what it leaves over is seen as it is written.
            seen = Observation()
            solved = solved.select(f"m_{m}", "t", F.col("to").alias("f"), apart.alias("apart")).observe(seen, F.max("apart").alias("apart"), F.max("f").alias("largest"))
            new[m] = stored(solved.drop("apart"), "factors")
            off, largest = max(off, seen.get["apart"] or 0.0), max(largest, seen.get["largest"] or 0.0)
        if largest > LARGEST:
            break
        still = still + 1 if k and off / total > STILL * residual else 0
        values, residual = new, off / total
        if residual <= TOLERANCE or still == 2:
            break
    if residual > REPORTED:
        warnings.warn(f"the targets cannot be met together: a marginal is off by {residual:.3g} of all tokens", stacklevel=2)
    weight = F.col("tokens") * F.col("f_source") * F.col("f_lang") * F.col("f_topic")
    return _with_factors(cells, values, sizes, MARGINS).select(*KEYS, "tokens", weight.alias("weight"), F.lit(residual).alias("residual"))


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, topic: str = TOPIC, tokens: str = TOKENS) -> DataFrame:
    """docs with n_tokens, the marginals, ``ratio``, ``probability`` and ``kept``, ``copies``, and ``residual``: by how much of all tokens the fit misses its targets."""
    own = [c for c in docs.columns if c not in ADDED]
    packed = with_cells(docs, topic, tokens).select(F.struct(*own).alias("doc"), "n_tokens", *KEYS, uniform().alias("u"))
    bins = stored(packed.groupBy(*KEYS, F.floor(F.col("u") * BINS).alias("bin")).agg(F.sum("n_tokens").alias("n")), "bins")
    cells = stored(bins.groupBy(*KEYS).agg(F.sum("n").alias("tokens")), "cells")
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)
    raked = stored(rake(cells, targets).withColumn("ratio", ratio), "raked")
    most = raked.filter("tokens > 0").agg(F.max("ratio")).first()[0] or 1.0
    probability = F.when(F.col("tokens") > 0, F.col("ratio") / F.lit(most)).otherwise(1.0)
    fitted = raked.select(*KEYS, "tokens", "ratio", probability.alias("probability"), "residual")
    so_far = Window.partitionBy(*KEYS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = bins.join(fitted, KEYS).withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))

    def cut(part: Column) -> Column:
        """The hash up to which a cell's tokens come to this part of them: within the last range that they reach, in proportion."""
        wanted = part * F.col("tokens")
        inside = F.least(F.lit(1.0), (wanted - F.col("before")) / F.col("n"))
        reached = F.max(F.when((F.col("before") < wanted) & (F.col("n") > 0), (F.col("bin") + inside) / BINS))
        return F.when(F.max(part) >= 1, 1.0).otherwise(F.coalesce(reached, F.lit(0.0)))

    p, more = F.col("probability"), F.col("ratio") - F.floor("ratio")
    cuts = ranges.groupBy(*KEYS).agg(F.first("ratio").alias("ratio"), F.first("probability").alias("probability"), F.first("residual").alias("residual"), cut(p).alias("cut"), cut(more).alias("cut_more"))
    cuts = stored(cuts, "cuts")
    both = packed.join(small_or_not(cuts, cuts.count(), 200), KEYS)
    taken = both.withColumns({"copies": F.floor("ratio") + (F.col("u") < F.col("cut_more")).cast("long"), "kept": F.col("u") < F.col("cut")})
    return taken.select("doc.*", *ADDED)


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, topic: str = TOPIC, tokens: str = TOKENS) -> DataFrame:
    """The documents as often as the calibrated ratios take them, with the columns they came with."""
    packed = docs.select(F.struct("*").alias("doc"), *[c for c in docs.columns if c != "doc"])
    taken = mix(packed, targets, topic, tokens).filter("copies > 0").select("doc", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    return taken.select("doc.*")


def achieved(mixed: DataFrame, copies: bool = False) -> DataFrame:
    """For each value of each marginal: its share of all tokens, of those kept (or taken by copies)."""
    times = F.col("copies") if copies else F.col("kept").cast("long")
    value = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(f"m_{m}").alias("value")) for m in MARGINS])).alias("v")
    sums = mixed.groupBy(*KEYS).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * times).alias("k")).select(value, "n", "k").groupBy("v").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    margin = Window.partitionBy("v.margin")
    return sums.select("v.*", (F.col("n") / F.sum("n").over(margin)).alias("observed"), (F.col("k") / F.sum("k").over(margin)).alias("achieved"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    return mix(docs).select("doc_id", "n_tokens", "source", "lang", F.col("m_topic").alias("topic"), F.round("probability", 6).alias("probability"), "kept")


def _fitted_sql(passes: int = 80) -> str:
    """Cells with their ratio r, from the definition: weight = tokens * a(source) * b(lang) * c(topic), each factor solved for its marginal in turn."""
    null = "'(none)'"
    steps = [
        f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
         coalesce(source, {null}) AS m_source, coalesce(lang, {null}) AS m_lang,
         CASE WHEN text LIKE '%|%|%' THEN 'table' WHEN regexp_matches(text, '[0-9]{{4}}') THEN 'figures' ELSE 'prose' END AS m_topic
  FROM documents
), cell AS MATERIALIZED (SELECT m_source, m_lang, m_topic, sum(n_tokens)::DOUBLE AS n FROM d GROUP BY ALL)"""
    ]
    for m in MARGINS:
        steps.append(f"""want_{m} AS MATERIALIZED (
  SELECT m_{m}, pow(n, {TEMPER}) / sum(pow(n, {TEMPER})) OVER () * (SELECT sum(n) FROM cell) AS t FROM (SELECT m_{m}, sum(n) AS n FROM cell GROUP BY m_{m})),
{m}0 AS MATERIALIZED (SELECT m_{m}, 1.0::DOUBLE AS f FROM want_{m})""")
    for k in range(1, passes + 1):
        for i, m in enumerate(MARGINS):
            p, q = (x for x in MARGINS if x != m)
            at = {x: k if MARGINS.index(x) < i else k - 1 for x in (p, q)}
            steps.append(f"""{m}{k} AS MATERIALIZED (
  SELECT m_{m}, CASE WHEN s > 0 THEN t / s ELSE 1 END AS f FROM want_{m} JOIN (
    SELECT m_{m}, sum(n * x.f * y.f) AS s FROM cell JOIN {p}{at[p]} x USING (m_{p}) JOIN {q}{at[q]} y USING (m_{q}) GROUP BY m_{m}) USING (m_{m}))""")
    a, b, c = (f"{m}{passes}" for m in MARGINS)
    steps.append(f"""fit AS MATERIALIZED (
  SELECT m_source, m_lang, m_topic, n, CASE WHEN n > 0 THEN a.f * b.f * c.f ELSE 1 END AS r FROM cell JOIN {a} a USING (m_source) JOIN {b} b USING (m_lang) JOIN {c} c USING (m_topic))""")
    return ", ".join(steps)


UNIFORM_SQL = f"('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0"
_CUT = "CASE WHEN max({x}) >= 1 THEN 1 ELSE coalesce(max(CASE WHEN before < {x} * n AND t > 0 THEN (bin + least(1, ({x} * n - before) / t)) / {bins} END), 0) END"
_DRAWN = f"""{_fitted_sql()}, one AS MATERIALIZED (SELECT *, CASE WHEN n > 0 THEN r / (SELECT max(r) FROM fit WHERE n > 0) ELSE 1 END AS p, r - floor(r) AS q FROM fit
), h AS MATERIALIZED (SELECT *, {UNIFORM_SQL} AS u FROM d
), bins AS (SELECT m_source, m_lang, m_topic, floor(u * {BINS}) AS bin, sum(n_tokens)::DOUBLE AS t FROM h GROUP BY ALL
), far AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY m_source, m_lang, m_topic ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bins JOIN one USING (m_source, m_lang, m_topic)
), cuts AS MATERIALIZED (SELECT m_source, m_lang, m_topic, any_value(p) AS p, any_value(r) AS r, {_CUT.format(x="p", bins=BINS)} AS cut, {_CUT.format(x="q", bins=BINS)} AS cut_more FROM far GROUP BY ALL)"""
SQL = f"""{_DRAWN}
SELECT doc_id, n_tokens, source, lang, m_topic AS topic, round(p, 6) AS probability, u < cut AS kept FROM h JOIN cuts USING (m_source, m_lang, m_topic)"""
COPIES_SQL = f"""{_DRAWN}
SELECT doc_id, n_tokens, source, lang, m_topic AS topic, round(r, 6) AS ratio, floor(r)::BIGINT + (u < cut_more)::BIGINT AS copies FROM h JOIN cuts USING (m_source, m_lang, m_topic)"""
