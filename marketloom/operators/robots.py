"""What robots files allow: rules of each answer, verdicts on addresses, and the answer that is in force at a fetch.

A file's rules stand in groups, each under the agents that it names; the group whose agent is the longest one contained in ours counts, else
that of ``*``; groups of the same agent are one. A rule's pattern is a prefix in which ``*`` stands for any text and a last ``$`` for the end. Of the
rules that match, the longest pattern decides, and allowing goes before forbidding. Patterns are compared as they are written.

An answer's rules are one row, as large as its file, so addresses meet them by a join on the origin that copies no address.

Cases: an address that is not http(s) has no origin and may not be fetched; an origin without an answer in force has to be asked first (verdict null); an answer
without rules for us allows all; empty rules say nothing; rules before any agent are left out; of several answers at one moment the greatest by status and body counts; a fetch
without a time has no answer in force.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_url, origin_of, robots_policy

#: How long an answer stays in force.
TTL = dt.timedelta(hours=24)
KEYS = ("user-agent", "allow", "disallow", "crawl-delay")


def path_of(url: Column) -> Column:
    """What patterns are held against: path and query, at least a slash."""
    rest = F.regexp_replace(canonical_url(url), "^https?://[^/?]*", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def compiled(pattern: Column) -> Column:
    """A rule's pattern as a regular expression."""
    body = F.regexp_replace(pattern, r"\$$", "")
    plain = F.regexp_replace(F.regexp_replace(body, r"[\\^$.|?+()\[\]{}]", r"\\$0"), r"\*+", ".*")
    return F.concat(F.lit("(?s)^"), plain, F.when(pattern.endswith("$"), "$").otherwise(""))


def lines_of(answers: DataFrame) -> DataFrame:
    """(origin, at, n, key, value, group): the lines of each answer's body that say something; a group begins with the first of its agents."""
    lines = answers.select("origin", "at", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n|\r|\n")).alias("n", "line"))
    clean = F.regexp_replace("line", "(?s)#.*", "")
    form = r"^\s*([A-Za-z-]+)\s*:\s*(.*?)\s*$"
    lines = lines.withColumns({"key": F.lower(F.regexp_extract(clean, form, 1)), "value": F.regexp_extract(clean, form, 2)}).filter(F.col("key").isin(*KEYS))
    by_line = Window.partitionBy("origin", "at").orderBy("n")  # as long as one file
    begins = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(by_line), F.lit("")) != "user-agent")
    return lines.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(by_line)).select("origin", "at", "n", "key", "value", "group")


def rules_of(answers: DataFrame, agent: str) -> DataFrame:
    """(origin, at, policy, rules, crawl_delay): a row for each answer (origin, at, status, body), with the rules that hold for this agent."""
    lines = lines_of(answers)
    weight = F.when(F.col("value") == "*", 0).when((F.col("value") != "") & F.lit(agent.lower()).contains(F.lower("value")), F.length("value"))
    named = lines.filter("key = 'user-agent'").select("origin", "at", "group", weight.alias("weight")).filter("weight is not null")
    said = lines.filter("key <> 'user-agent' and value <> ''")
    rule = F.when(F.col("key") != "crawl-delay", F.struct(F.length("value").alias("size"), (F.col("key") == "allow").alias("allow"), compiled(F.col("value")).alias("form")))
    delay = F.when(F.col("key") == "crawl-delay", F.col("value").try_cast("double"))
    own = named.join(said.select("origin", "at", "group", rule.alias("rule"), delay.alias("delay")), ["origin", "at", "group"], "left")
    sets = own.groupBy("origin", "at", "weight").agg(F.collect_set("rule").alias("rules"), F.max("delay").alias("delay"))
    best = sets.groupBy("origin", "at").agg(F.max_by(F.struct("rules", "delay"), "weight").alias("best"))
    latest = answers.groupBy("origin", "at").agg(F.max(F.struct("status", "body")).alias("a"))
    policy = robots_policy(F.col("a.status"), F.col("a.body").isNotNull())
    return latest.join(best, ["origin", "at"], "left").select("origin", "at", policy.alias("policy"), "best.rules", F.col("best.delay").alias("crawl_delay"))


def verdict(url: Column, policy: Column, rules: Column) -> Column:
    """Whether an address may be fetched, by its origin's answer; null without one."""
    path = path_of(url)
    held = F.array_max(F.transform(F.filter(rules, lambda r: F.rlike(path, r["form"])), lambda r: F.struct(r["size"], r["allow"])))
    ruled = F.coalesce(held["allow"], F.lit(True)) | (path == "/robots.txt")
    return F.when(canonical_url(url).isNull(), False).when(policy == "unavailable", True).when(policy == "unreachable", False).when(policy == "parsed", ruled)


def judged(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with origin, policy, allowed and reason, by one row of rules for each origin."""
    named = urls.withColumn("origin", F.nullif(origin_of(F.col(url)), F.lit("")))
    met = named.join(rules.select("origin", "policy", "rules", "crawl_delay"), "origin", "left")
    return _told(met, url).drop("rules")


def _told(met: DataFrame, url: str) -> DataFrame:
    out = met.withColumn("allowed", verdict(F.col(url), F.col("policy"), F.col("rules")))
    # What a verdict is based on.
    reason = (
        F.when(F.col("policy") == "unavailable", "no robots.txt published (4xx); nothing is restricted")
        .when(F.col("policy") == "unreachable", "robots.txt could not be read; assuming complete disallow per RFC 9309")
        .when(F.col("policy") == "parsed", F.when(F.col("allowed"), "allowed by robots.txt").otherwise("matched a Disallow rule"))
    )
    return out.withColumn("reason", reason)


def in_force(fetches: DataFrame, answers: DataFrame, ttl: dt.timedelta = TTL) -> DataFrame:
    """fetches (origin, ts, ...) with ``at``: when the answer was given that is in force then, the last one before or at ts and less than ``ttl`` old; else null.

    Time is cut into cells of one ttl. An answer stands in its own cell and the next one, where it may still be in force; so an origin with
    a third of all fetches is as many groups as it has cells, and each is read once in order.
    """
    micros = int(ttl / dt.timedelta(microseconds=1))
    rest = [c for c in fetches.columns if c != "origin"]
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asked = fetches.select("origin", us("ts").alias("_us"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_at"), F.struct(*rest).alias("_row"))
    asked = asked.withColumn("_cell", F.floor(F.col("_us") / micros))
    given = answers.select("origin", us("at").alias("_us")).filter("_us is not null").distinct()
    cell = F.floor(F.col("_us") / micros)
    given = given.select("origin", "_us", F.lit(0).alias("_kind"), F.col("_us").alias("_at"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.explode(F.array(cell, cell + 1)).alias("_cell"))
    by_time = Window.partitionBy("origin", "_cell").orderBy("_us", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = asked.unionByName(given).withColumn("_last", F.last("_at", ignorenulls=True).over(by_time)).filter("_kind = 1")
    fresh = F.when(F.col("_us") - F.col("_last") < micros, F.timestamp_micros("_last"))
    return met.select("origin", "_row.*", fresh.alias("at"))


def fetches_judged(fetches: DataFrame, answers: DataFrame, agent: str, ttl: dt.timedelta = TTL) -> DataFrame:
    """fetches (url, ts, ...) with origin, at, policy, allowed, reason and crawl_delay by the answers (origin, at, status, body) in force; allowed is null where the origin has to be asked first."""
    named = fetches.withColumn("origin", F.nullif(origin_of(F.col("url")), F.lit("")))
    found = in_force(named, answers, ttl).join(rules_of(answers, agent), ["origin", "at"], "left")
    return _told(found, "url").drop("rules")
