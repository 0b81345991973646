import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import movers, pages, robust
from marketloom.schemas import RobustConfig

FACTS = "source string, commodity string, market long, observed_on date, low decimal(12,2), high decimal(12,2), prevailing decimal(12,2), average decimal(12,2), unavailable boolean"


@pytest.fixture(scope="module")
def facts(spark):
    rows = []
    for market in (1, 2, 3):
        for day in range(1, 21):
            p = Decimal(10 * market + (50 if (market, day) == (1, 12) else day % 3))
            gone = day % 7 == 0
            rows.append(("s", "rice" if market < 3 else "corn", market, dt.date(2020, 1, day), *[None if gone else p] * 4, gone))
    return spark.createDataFrame(rows, FACTS)


@pytest.fixture(scope="module")
def markets(spark):
    return spark.createDataFrame([(1, "r1", "a", "x"), (2, "r2", "b", "y"), (3, "r1", "c", "z")], "id long, region_psgc_code string, name string, municipality string")


def test_filters(facts, markets):
    assert pages.observations(facts).count() == 54 and pages.observations(facts, include_unavailable=True).count() == 60
    assert {r.market for r in pages.observations(facts, region="r1", markets=markets).collect()} == {1, 3}
    assert pages.observations(facts, commodity="", source="s", market=2, date_from=dt.date(2020, 1, 3), date_to=dt.date(2020, 1, 5)).count() == 3
    with pytest.raises(ValueError):
        pages.observations(facts, date_from=dt.date(2020, 1, 3), date_to=dt.date(2020, 1, 2))
    with pytest.raises(ValueError):
        pages.observations(facts, region="r1")


def test_presented_and_chart(spark, facts, markets):
    dim = spark.createDataFrame([("rice", "GRAIN", None, "kg", "rice-x"), ("corn", "GRAIN", "dry", "kg", "corn-x")], "name string, group string, specification string, unit string, canonical_slug string")
    sources = spark.createDataFrame([("s", "Source")], "slug string, name string")
    row = pages.presented(facts, dim, markets, sources).filter("market = 3").first()
    assert (row["group"], row.specification, row.market_name, row.municipality, row.region_psgc_code, row.source_name) == ("GRAIN", "dry", "c", "z", "r1", "Source")
    assert [r.name for r in pages.commodity(dim, "corn-x").collect()] == ["corn"] and pages.commodity(dim, "oats").count() == 0
    shown = pages.chart(facts, "rice", 30, dt.date(2020, 2, 10), region="r2", markets=markets).collect()
    assert [r.observed_on.day for r in shown] == [d for d in range(11, 21) if d % 7] and {r.market for r in shown} == {2}
    with pytest.raises(ValueError):
        pages.chart(facts, "rice", 31, dt.date(2020, 2, 10))


def test_movers_anchor_and_default(facts):
    assert movers.latest(facts) == dt.date(2020, 1, 20) and movers.latest(facts.limit(0)) is None
    assert movers.movers(facts.limit(0)).count() == 0 and movers.default_commodity(facts.limit(0)).count() == 0
    assert movers.default_commodity(facts.filter("market <> 3 or observed_on > '2020-01-10'")).first().commodity == "rice"
    with pytest.raises(ValueError):
        movers.movers(facts, 366)


def test_filters_come_before_windows(facts, markets):
    def flagged(**given):
        return {(r.market, r.observed_on.day) for r in robust.anomalies(robust.flagged_observations(facts, RobustConfig(window=9), **given)).collect()}

    assert flagged() == {(1, 12)} == flagged(region="r1", markets=markets) == flagged(market=1, commodity="rice") and flagged(region="r2", markets=markets) == set()
    # With three neighbours in range there is no score.
    assert flagged(date_from=dt.date(2020, 1, 11), date_to=dt.date(2020, 1, 14)) == set()
    assert flagged(date_from=dt.date(2020, 1, 3), date_to=dt.date(2020, 1, 2)) == set()


@pytest.mark.parametrize("bad", [(2, 3.5), (62, 3.5), (9, 0), (9, 50.1)])
def test_request_bounds(bad):
    assert RobustConfig.requested(61, 50) == RobustConfig(window=61, threshold=50)
    with pytest.raises(ValueError):
        RobustConfig.requested(*bad)


def test_shown_texts(spark):
    df = spark.createDataFrame([(Decimal("1234567.50"), 0.25, dt.date(2020, 3, 4), "rice", "red"), (None, -1.0, dt.date(2020, 12, 31), "corn", None), (Decimal("0.10"), 0.0, None, "oats", "")], "a decimal(12,2), p double, d date, n string, s string")
    got = df.select(text.peso(F.col("a")), text.percent(F.col("p")), text.short_date(F.col("d")), text.long_date(F.col("d")), text.days_ago(4, F.col("d")), text.commodity_label(F.col("n"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [
        ("₱1,234,567.50", "+0.3%", "4 Mar", "4 March 2020", dt.date(2020, 2, 29), "rice (red)"), ("—", "-1.0%", "31 Dec", "31 December 2020", dt.date(2020, 12, 27), "corn"),
        ("₱0.10", "0.0%", None, None, None, "oats"),
    ]
