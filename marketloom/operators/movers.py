"""Biggest movers: first against last price of each series inside a window of days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(observations: DataFrame) -> dt.date | None:
    """The latest date of all observations, those without a price included."""
    return observations.agg(F.max("observed_on")).first()[0]


def movers(observations: DataFrame, window_days: int = 7, as_of: dt.date | None = None, keys: tuple[str, ...] = ("commodity", "market")) -> DataFrame:
    """One row per series with two or more prices in the window: first and last price, change and percent.

    The anchor is ``as_of`` or the latest date of all observations, which is read first (of a table with its dates in the file statistics
    that is no scan), so that the window's dates are literals that reach the scan. The window excludes its start. First and last are
    two aggregates of one grouping (no self-join, no sort). Of two sources on one day the greater price counts.
    """
    if not 1 <= window_days <= 365:
        raise ValueError(f"window_days must be 1 to 365, got {window_days}")
    if as_of is None:
        as_of = latest(observations)
    if as_of is None:
        priced = observations.filter("average > 0 and false")
    else:
        priced = observations.filter((F.col("average") > 0) & (F.col("observed_on") > F.lit(as_of - dt.timedelta(days=window_days))) & (F.col("observed_on") <= F.lit(as_of)))
    at = lambda f, by: f("average", F.struct("observed_on", F.col("average") if by > 0 else -F.col("average")))
    out = priced.groupBy(*keys).agg(
        F.min("observed_on").alias("first_on"), F.max("observed_on").alias("last_on"),
        at(F.min_by, -1).alias("first_average"), at(F.max_by, 1).alias("last_average"), F.count("*").alias("observations"),
    )
    change = F.col("last_average") - F.col("first_average")
    return out.filter("observations >= 2").select(
        "*", change.alias("change"), (change.cast("double") * 100 / F.col("first_average").cast("double")).alias("percent_change")
    )


def default_commodity(observations: DataFrame) -> DataFrame:
    """The commodity to show first: the biggest mover of 30 days."""
    return top(movers(observations, 30), 1).select("commodity")


def top(moved: DataFrame, limit: int = 20, offset: int = 0, keys: tuple[str, ...] = ("commodity", "market")) -> DataFrame:
    return moved.orderBy(F.desc(F.round(F.abs("percent_change"), 9)), *keys).offset(offset).limit(limit)
