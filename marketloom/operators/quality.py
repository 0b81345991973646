"""Data-quality roll-ups: per source, per stage, and over all observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_source(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of every source, those without any included; the rate of success is null without runs.

    Runs are summed by source first, in each task before they move, so one busy source is one row of each task; the sums then join the sources.
    """
    one = lambda s: F.count_if(F.col("status") == s)
    sums = runs.groupBy(F.col("source").alias("slug")).agg(
        F.count("*").alias("runs"), one("succeeded").alias("succeeded"), one("failed").alias("failed"), one("partial").alias("partial"),
        F.max("started_at").alias("last_run_at"), F.max(F.when(F.col("status") == "succeeded", F.col("started_at"))).alias("last_success_at"),
        F.sum("rows_upserted").alias("rows_upserted"), F.sum("rows_quarantined").alias("rows_quarantined"),
    )
    out = sources.select("slug", "name").join(sums, "slug", "left").fillna(0, ["runs", "succeeded", "failed", "partial", "rows_upserted", "rows_quarantined"])
    return out.withColumn("success_rate", F.when(F.col("runs") > 0, F.col("succeeded") / F.col("runs"))).orderBy("slug")


def per_stage(quarantine: DataFrame, locale: str | None = None) -> DataFrame:
    """Quarantined rows per stage; the example is the least reason in binary order, or in that of a locale."""
    reason = F.col("reason")
    least = F.min(reason) if locale is None else F.min(F.struct(F.collate(reason, locale).alias("shown"), reason.alias("plain")))["plain"]
    return quarantine.groupBy("stage").agg(F.count("*").alias("rows"), least.alias("example_reason")).orderBy(F.desc("rows"), "stage")


def quarantined_total(quarantine: DataFrame) -> DataFrame:
    """All quarantined rows, as the sum over the stages."""
    return per_stage(quarantine).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("quarantined"))


def totals(observations: DataFrame) -> DataFrame:
    impossible = F.col("average").isNotNull() & ((F.col("average") < F.col("low")) | (F.col("average") > F.col("high")))
    return observations.agg(
        F.count("*").alias("observations"), F.count_if("unavailable").alias("unavailable"), F.count_if(impossible).alias("impossible"),
        F.min("observed_on").alias("first_on"), F.max("observed_on").alias("last_on"), F.countDistinct("commodity").alias("commodities_observed"),
    )


def null_rate(observations: DataFrame) -> DataFrame:
    """Share of observations of each commodity that have no average (an extension)."""
    return observations.groupBy("commodity").agg(F.count("*").alias("observations"), F.avg(F.col("average").isNull().cast("double")).alias("null_rate"))


def coverage(commodities: DataFrame, observations: DataFrame) -> DataFrame:
    """How many commodities are seeded, and how many have been observed at all."""
    zero = F.lit(0).cast("long")
    counts = commodities.agg(F.count("*").alias("seeded"), zero.alias("observed")).union(observations.agg(zero, F.countDistinct("commodity")))
    return counts.agg(F.sum("seeded").alias("seeded"), F.sum("observed").alias("observed"))
