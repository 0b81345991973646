"""Filtered, totally ordered pages over facts and dimensions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..schemas import INPUT_GROUPS, PageRequest


#: The total order of facts: date, then what else makes a fact unique.
OBSERVATION_ORDER = ["observed_on", "commodity", "market", "source"]
#: The spans that the chart offers.
CHART_DAYS = (30, 90, 365)


def page(df: DataFrame, order: list, request: PageRequest = PageRequest()) -> DataFrame:
    """One page; ``order`` has to end in a unique key. Spark keeps only offset + limit rows of each task."""
    return df.orderBy(*order).offset(request.offset).limit(request.limit)


def total(df: DataFrame) -> DataFrame:
    """The number of rows regardless of paging."""
    return df.agg(F.count("*").alias("total"))


def in_locale(names: list[str], locale: str = "UNICODE") -> list[Column]:
    """An order by names as a locale's readers expect it (case and accents after letters), and by their bytes where it tells two names not apart."""
    return [c for n in names for c in (F.collate(F.col(n), locale), F.col(n))]


def page_and_total(df: DataFrame, order: list, request: PageRequest = PageRequest()) -> tuple[list[Row], int]:
    """(rows of a page, number of all rows) from one job over one scan: rows are counted as they pass by on their way to the page."""
    seen = Observation()
    rows = page(df.observe(seen, F.count(F.lit(1)).alias("total")), order, request).collect()  # at most a page
    return rows, seen.get["total"]


def seek(df: DataFrame, order: list[str], after: Row | dict | None, limit: int = 50) -> DataFrame:
    """The page after a row, which is given by its values of ``order`` (names, a leading - for descending; unique together).

    What stands before it is filtered out, by the scan where it can, instead of being sorted to be skipped. Nulls come first in
    ascending and last in descending order, as Spark sorts them.
    """
    PageRequest(limit)
    names = [(o.removeprefix("-"), o.startswith("-")) for o in order]
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for name, down in names:
            value = after[name]
            if down:
                later = (F.col(name) < F.lit(value)) | F.col(name).isNull() if value is not None else F.lit(False)
            else:
                later = F.col(name) > F.lit(value) if value is not None else F.col(name).isNotNull()
            beyond = beyond | (same & F.coalesce(later, F.lit(False)))
            same = same & F.col(name).eqNullSafe(F.lit(value))
        df = df.filter(beyond)
    return df.orderBy(*[F.desc(n) if down else F.asc(n) for n, down in names]).limit(limit)


def dated(facts: DataFrame, date_from: dt.date | None = None, date_to: dt.date | None = None) -> DataFrame:
    if date_from:
        facts = facts.filter(F.col("observed_on") >= F.lit(date_from))
    if date_to:
        facts = facts.filter(F.col("observed_on") <= F.lit(date_to))
    return facts


def presented(facts: DataFrame, commodities: DataFrame, markets: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts with what their dimensions say: the commodity's group, specification and unit, the market's name, town and region, the source's name."""
    c = commodities.select(F.col("name").alias("commodity"), F.col("group"), "specification", "unit")
    m = markets.select(F.col("id").alias("market"), F.col("name").alias("market_name"), "municipality", "region_psgc_code")
    s = sources.select(F.col("slug").alias("source"), F.col("name").alias("source_name"))
    return facts.join(c, "commodity").join(m, "market").join(s, "source")


def chart(facts: DataFrame, commodity: str, days: int, until: dt.date, region: str | None = None, markets: DataFrame | None = None) -> DataFrame:
    """What a chart of one commodity shows: its last days up to a date, in pages of at most 500."""
    if days not in CHART_DAYS:
        raise ValueError(f"days must be one of {CHART_DAYS}, got {days}")
    found = observations(facts, commodity=commodity, date_from=until - dt.timedelta(days=days), region=region, markets=markets)
    return page(found, ["observed_on", "market", "source"], PageRequest(500))


def commodity(dim: DataFrame, slug: str) -> DataFrame:
    """The one commodity with this slug, with the farm-input flag; no row if there is none."""
    return commodities(dim.filter(F.col("canonical_slug") == slug)).limit(1)


def observations(
    facts: DataFrame, commodity: str | None = None, market: int | None = None, source: str | None = None,
    date_from: dt.date | None = None, date_to: dt.date | None = None, include_unavailable: bool = False, region: str | None = None, markets: DataFrame | None = None,
) -> DataFrame:
    """Facts that match what is given; both ends of the dates included. Blank strings mean no filter. A region is that of the market, by ``markets``."""
    if date_from and date_to and date_from > date_to:
        raise ValueError(f"{date_from} is after {date_to}")
    for name, value in (("commodity", commodity), ("market", market), ("source", source)):
        if value is not None and value != "":
            facts = facts.filter(F.col(name) == value)
    if region:
        if markets is None:
            raise ValueError("a region is looked up in markets")
        own = markets.filter(F.col("region_psgc_code") == region).select(F.col("id").alias("market"))
        facts = facts.join(own, "market", "left_semi")
    facts = dated(facts, date_from, date_to)
    return facts if include_unavailable else facts.filter("not unavailable")


def commodities(dim: DataFrame, q: str | None = None, group: str | None = None, include_inputs: bool = True) -> DataFrame:
    """Commodities with the farm-input flag. ``q`` is a pattern of ILIKE: % and _ in it keep their meaning."""
    if q:
        dim = dim.filter(F.col("name").ilike(f"%{q}%"))
    if group:
        dim = dim.filter(F.col("group") == group)
    if not include_inputs:
        dim = dim.filter(~F.col("group").isin(*INPUT_GROUPS))
    return dim.withColumn("is_agricultural_input", F.upper("group").isin(*INPUT_GROUPS))


def search(dim: DataFrame, text: str, include_inputs: bool = False) -> DataFrame:
    """Commodities whose name, group or specification holds the text, in any case."""
    low = text.lower()
    hit = F.lit(False)
    for c in ("name", "group", "specification"):
        hit = hit | (F.instr(F.lower(F.coalesce(F.col(c), F.lit(""))), low) > 0)
    return commodities(dim.filter(hit), include_inputs=include_inputs).orderBy("group", "name", "id")


def region_options(regions: DataFrame, markets: DataFrame) -> DataFrame:
    """Regions that have a market, with their number."""
    counts = markets.groupBy("region_psgc_code").agg(F.count("*").alias("markets"))
    return regions.join(F.broadcast(counts), regions["psgc_code"] == counts["region_psgc_code"]).select("psgc_code", "name", "markets").orderBy("name")


def price_pivot(facts: DataFrame, commodity: str, markets: int = 6) -> DataFrame:
    """Dates by market for the chart: the first markets by id, blank where a market has no price that day."""
    priced = observations(facts, commodity=commodity).filter("average is not null")
    ids = [r[0] for r in priced.select("market").distinct().orderBy("market").limit(markets).collect()]  # at most ``markets`` values
    return priced.filter(F.col("market").isin(*ids)).groupBy("observed_on").pivot("market", ids).agg(F.first("average")).orderBy("observed_on")
