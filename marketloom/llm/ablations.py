"""What each rule of the line policy rejects over the whole table: rules that never fire show as zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality
from .common import documents


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.ledger(documents(spark, sf_dir).select("doc_id", "text"), quality.LINE_RULES, quality.LINE_MEASURES)
    return quality.ablations(judged, quality.LINES, quality.LINE_RULES)


def _sql() -> str:
    measured, _ = quality.SQL.rsplit("), b AS (", 1)
    rules = ", ".join(f"('{r.name}', {1 << r.bit})" for r in quality.LINE_RULES)
    return rf"""{measured}
), nl AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), x AS (
  SELECT m.*, coalesce(nl.n, 0) AS n_lines, length(regexp_replace(d.body, '[^{quality.UNSPACED}]', '', 'g')) AS n_unspaced
  FROM m JOIN d USING (doc_id) LEFT JOIN nl USING (doc_id)
), b AS (
  SELECT (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN word_chars > 10 * n_words AND 10 * n_unspaced < word_chars THEN 64 ELSE 0 END)::BIGINT AS bits FROM x
)
SELECT '{quality.LINES.version}' AS policy, rule, count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits = bit) AS n_only
FROM b, (VALUES {rules}) AS r(rule, bit) GROUP BY rule"""


SQL = _sql()
