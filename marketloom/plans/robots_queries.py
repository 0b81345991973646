"""Queries over robots answers that Spark makes of the given tables: every origin of ``pages`` has one, or as many as ``events`` say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import robots
from . import bridge as b
from .registry import query

AGENT = "marketbot/1.0"
#: A common group, one for another agent, one for ours in every third file.
BODY = "# rules\nUser-agent: *\nDisallow: /en/\nAllow: /en/*5\nDisallow: /*?*ref=\nDisallow: /fr/8*$ # eights\nAllow: /en/6.$\nDisallow:\nCrawl-delay: 2\n\nUSER-AGENT: otherbot\nUser-agent: another\nDisallow: /\n"
OWN = "User-agent: MarketBot\nallow: /*.html$\nDisallow: /*/\nDisallow: /en/1\nAllow: /en/1\n"
#: The same by hand: group, length, allow, expression.
RULES_SQL = r"""(VALUES ('*', 4, false, '^/en/.*$'), ('*', 6, true, '^/en/.*5.*$'), ('*', 8, false, '^/.*\?.*ref=.*$'), ('*', 7, false, '^/fr/8.*$'), ('*', 7, true, '^/en/6\.$'),
  ('own', 8, true, '^/.*\.html$'), ('own', 3, false, '^/.*/.*$'), ('own', 5, false, '^/en/1.*$'), ('own', 5, true, '^/en/1.*$')) r(grp, size, allow, form)"""


def _answers(spark, sf):
    origins = b.table(spark, sf, "pages").select(text.origin_of(F.col("url")).alias("origin")).distinct()
    n = F.length("origin")
    status = F.when(n % 7 == 0, 503).when(n % 5 == 0, 404).otherwise(200)
    return origins.select("origin", F.lit("2024-01-01").cast("timestamp").alias("at"), status.alias("status"), F.when(n % 3 == 0, BODY + OWN).otherwise(BODY).alias("body"))


@query(rf"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS path FROM pages),
p AS (SELECT *, length(origin) AS n, CASE WHEN length(origin) % 7 = 0 THEN 'unreachable' WHEN length(origin) % 5 = 0 THEN 'unavailable' ELSE 'parsed' END AS policy FROM u),
m AS (SELECT page_id, arg_max(allow, size * 2 + allow::INT) AS held FROM p JOIN {RULES_SQL} ON grp = CASE WHEN n % 3 = 0 THEN 'own' ELSE '*' END AND regexp_matches(path, form) GROUP BY page_id)
SELECT p.page_id, origin, policy, CASE policy WHEN 'unreachable' THEN false WHEN 'unavailable' THEN true ELSE coalesce(held, true) END AS allowed, CASE WHEN n % 3 <> 0 THEN 2.0::DOUBLE END AS crawl_delay
FROM p LEFT JOIN m ON m.page_id = p.page_id""")
def robots_verdicts(spark, sf):
    """Which pages the robots file of their origin lets us fetch."""
    found = robots.judged(b.table(spark, sf, "pages").select("page_id", "url"), robots.rules_of(_answers(spark, sf), AGENT))
    return found.select("page_id", "origin", "policy", "allowed", "crawl_delay")


@query("""WITH e AS (SELECT event_id, 'https://h' || user_id % 20 || '.example' AS origin, ts, event_type FROM events), a AS (SELECT DISTINCT origin, ts AS at FROM e WHERE event_type = 'error' AND event_id % 7 < 2)
SELECT event_id, CASE WHEN f.ts - a.at < INTERVAL 24 HOUR THEN strftime(a.at, '%Y-%m-%d %H:%M:%S') END AS at FROM (SELECT * FROM e WHERE event_type <> 'error') f ASOF LEFT JOIN a ON a.origin = f.origin AND a.at <= f.ts""")
def robots_in_force(spark, sf):
    """The answer in force at each fetch: some error events stand for answers, all others for fetches."""
    e = b.table(spark, sf, "events").select("event_id", F.concat(F.lit("https://h"), F.col("user_id") % 20, F.lit(".example")).alias("origin"), "ts", "event_type")
    answers = e.filter("event_type = 'error' and event_id % 7 < 2").select("origin", F.col("ts").alias("at"))
    return robots.in_force(e.filter("event_type <> 'error'").select("origin", "event_id", "ts"), answers).select("event_id", "at")
