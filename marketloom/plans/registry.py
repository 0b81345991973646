"""Registered queries over the given tables, each with its DuckDB twin.

Results hold plain types: money as double of two places, dates and times as text, so that two engines compare value by value.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dates import MONTHS, SHORT, read_date
from ..operators import movers, pages, quality, resolve, robust, state
from ..schemas import PageRequest, RobustConfig
from ..sources import listing, rawstore, sheets
from . import bridge as b

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Money as double, dates as text, counts as long."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "date":
            c = c.cast("string")
        elif kind == "timestamp" or kind == "timestamp_ntz":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "int":
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def query(sql: str | None = None):
    """Registers a function under its name."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import robots_queries, sheet_queries, store_queries  # noqa: F401  register their queries here

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


PRICE_COLUMNS = "source, commodity, market, observed_on::VARCHAR AS observed_on, low, high, prevailing, average, unavailable"
MID = dt.date(2024, 1, 16)


@query(f"SELECT {PRICE_COLUMNS} FROM ({b.OBSERVATIONS_SQL}) WHERE NOT unavailable ORDER BY observed_on, commodity, market, source LIMIT 50 OFFSET 100")
def observations_page(spark, sf):
    found = pages.observations(b.observations(spark, sf))
    return pages.page(found, pages.OBSERVATION_ORDER, PageRequest(50, 100))


@query(f"SELECT {PRICE_COLUMNS} FROM ({b.SHIPMENTS_SQL}) WHERE NOT unavailable ORDER BY observed_on, commodity, market, source LIMIT 200 OFFSET 50")
def observations_sought(spark, sf):
    """Four pages, each sought from the last row of the one before, after a first one of fifty."""
    found, last, rows = pages.observations(b.shipments(spark, sf)), None, []
    for size in (50, 50, 50, 50, 50):
        some = pages.seek(found, pages.OBSERVATION_ORDER, last, size).collect()  # a page
        last, rows = some[-1] if some else last, [*rows, *some]
    return spark.createDataFrame(rows[50:], found.schema)


@query(f"SELECT {PRICE_COLUMNS}, (SELECT count(*) FROM ({b.OBSERVATIONS_SQL}) WHERE NOT unavailable) AS total FROM ({b.OBSERVATIONS_SQL}) WHERE NOT unavailable ORDER BY observed_on, commodity, market, source LIMIT 50 OFFSET 100")
def observations_page_and_total(spark, sf):
    """A page and the number of all rows, by one job."""
    found = pages.observations(b.observations(spark, sf))
    rows, total = pages.page_and_total(found, pages.OBSERVATION_ORDER, PageRequest(50, 100))
    return spark.createDataFrame(rows, found.schema).withColumn("total", F.lit(total).cast("long"))


@query(f"SELECT {PRICE_COLUMNS} FROM ({b.OBSERVATIONS_SQL}) WHERE commodity = 'click' AND observed_on BETWEEN DATE '2024-01-05' AND DATE '2024-01-16' AND NOT unavailable")
def observations_dated(spark, sf):
    return pages.observations(b.observations(spark, sf), commodity="click", date_from=dt.date(2024, 1, 5), date_to=MID)


@query(f"SELECT {PRICE_COLUMNS} FROM ({b.OBSERVATIONS_SQL}) WHERE unavailable")
def observations_unavailable(spark, sf):
    return pages.observations(b.observations(spark, sf), include_unavailable=True).filter("unavailable")


@query(f"SELECT commodity, market, observed_on::VARCHAR AS observed_on, average FROM ({b.SHIPMENTS_SQL}) WHERE NOT unavailable AND market IN (SELECT id FROM ({b.MARKETS_SQL}) WHERE region_psgc_code = '1')")
def observations_by_region(spark, sf):
    return pages.observations(b.shipments(spark, sf), region="1", markets=b.markets(spark, sf)).select("commodity", "market", "observed_on", "average")


@query(f"SELECT count(*) AS total FROM ({b.OBSERVATIONS_SQL}) WHERE NOT unavailable")
def page_total(spark, sf):
    return pages.total(pages.observations(b.observations(spark, sf)))


@query(f"SELECT name, \"group\", id, specification, unit, upper(\"group\") = 'FERTILIZER' AS is_agricultural_input FROM ({b.COMMODITIES_SQL}) WHERE name ILIKE '%brand#1%'")
def commodity_search(spark, sf):
    return pages.commodities(b.commodities(spark, sf), q="brand#1")


@query(f"SELECT name, \"group\", id, specification, unit, false AS is_agricultural_input FROM ({b.COMMODITIES_SQL}) WHERE (contains(lower(name), 'ring') OR contains(lower(\"group\"), 'ring') OR contains(lower(specification), 'ring')) AND \"group\" <> 'FERTILIZER'")
def commodity_text_search(spark, sf):
    return pages.search(b.commodities(spark, sf), "ring")


@query(f"SELECT name, \"group\", id, specification, unit, false AS is_agricultural_input FROM ({b.COMMODITIES_SQL}) WHERE \"group\" <> 'FERTILIZER'")
def commodity_inputs_excluded(spark, sf):
    return pages.commodities(b.commodities(spark, sf), include_inputs=False)


@query(f"SELECT id, region_psgc_code, name, municipality FROM ({b.MARKETS_SQL}) WHERE region_psgc_code = '2' ORDER BY municipality, name, id LIMIT 50")
def markets_by_region(spark, sf):
    return pages.page(b.markets(spark, sf).filter("region_psgc_code = '2'"), ["municipality", "name", "id"])


@query(f"SELECT run_id, source, status, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, rows_upserted, rows_quarantined FROM ({b.RUNS_SQL}) ORDER BY started_at DESC, run_id DESC LIMIT 50")
def runs_recent(spark, sf):
    return pages.page(b.runs(spark, sf), [F.desc("started_at"), F.desc("run_id")])


def _movers_sql(rows: str, days: int, anchor: str = "", more: str = "", limit: str = "") -> str:
    return f"""WITH o AS ({rows}), a AS (SELECT {anchor or 'max(observed_on)'} AS anchor FROM o {'LIMIT 1' if anchor else ''}), p AS (
  SELECT * FROM o, a WHERE average > 0 AND observed_on > anchor - INTERVAL {days} DAY AND observed_on <= anchor {more}), m AS (
  SELECT commodity, market, min(observed_on)::VARCHAR AS first_on, max(observed_on)::VARCHAR AS last_on, arg_min(average, observed_on) AS f, arg_max(average, observed_on) AS l, count(*) AS observations
  FROM p GROUP BY ALL HAVING count(*) >= 2)
SELECT commodity, market, first_on, last_on, f AS first_average, l AS last_average, observations, round(l - f, 2) AS change, round((l - f) * 100 / f, 6) AS percent_change FROM m {limit}"""


def _moved(df: DataFrame) -> DataFrame:
    return df.withColumn("change", F.col("change").cast("decimal(12,2)")).withColumn("percent_change", F.round("percent_change", 6))


@query(_movers_sql(b.OBSERVATIONS_SQL, 7))
def movers_7d(spark, sf):
    return _moved(movers.movers(b.observations(spark, sf), 7))


@query(_movers_sql(b.OBSERVATIONS_SQL, 30, limit="ORDER BY round(abs((l - f) * 100 / f), 9) DESC, commodity, market LIMIT 20"))
def movers_30d(spark, sf):
    return _moved(movers.top(movers.movers(b.observations(spark, sf), 30), 20))


@query(_movers_sql(b.OBSERVATIONS_SQL, 7, "DATE '2024-01-16'"))
def movers_as_of(spark, sf):
    return _moved(movers.movers(b.observations(spark, sf), 7, MID))


@query(_movers_sql(b.SHIPMENTS_SQL, 365, more=f"AND market IN (SELECT id FROM ({b.MARKETS_SQL}) WHERE region_psgc_code = '1') AND commodity NOT LIKE 'PROMO%'"))
def movers_region(spark, sf):
    """Farm inputs are left out; the anchor is the latest date of all observations."""
    facts = b.shipments(spark, sf)
    food = pages.commodities(b.commodities(spark, sf), include_inputs=False).select(F.col("name").alias("commodity"))
    own = pages.observations(facts, region="1", markets=b.markets(spark, sf), include_unavailable=True)
    return _moved(movers.movers(own.join(food, "commodity", "left_semi"), 365, movers.latest(facts)))


def _anomaly_sql(rows: str, window: int, threshold: float, flagged: bool) -> str:
    r = window // 2
    return f"""WITH o AS ({rows}), n AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY commodity, market ORDER BY observed_on) - 1 AS i, count(*) OVER (PARTITION BY commodity, market) AS n FROM o
), e AS (SELECT *, greatest(0, i - {r}) AS a0, least(n, i + {r} + 1) AS b0 FROM n
), f AS MATERIALIZED (SELECT *, CASE WHEN b0 - a0 < {window} AND a0 > 0 THEN greatest(0, b0 - {window}) ELSE a0 END AS a, CASE WHEN b0 - a0 < {window} AND a0 = 0 THEN least(n, {window}) ELSE b0 END AS b FROM e
), p AS MATERIALIZED (SELECT commodity, market, i, unnest(range(a, b)) AS j FROM f
), nb AS MATERIALIZED (SELECT p.commodity, p.market, p.i, x.average AS v FROM p JOIN n x ON p.commodity = x.commodity AND p.market = x.market AND p.j = x.i WHERE p.i <> p.j AND x.average IS NOT NULL
), c AS MATERIALIZED (SELECT commodity, market, i, count(*) AS k, median(v) AS c FROM nb GROUP BY ALL
), d AS (SELECT nb.commodity, nb.market, nb.i, any_value(k) AS k, any_value(c) AS c, median(abs(v - c)) AS mad, avg(abs(v - c)) AS mean FROM nb JOIN c USING (commodity, market, i) GROUP BY ALL
), s AS (SELECT f.*, d.c, d.k, CASE WHEN mad > 1e-12 THEN mad / 0.6745 WHEN mean > 1e-12 THEN mean * 1.253314 END AS scale FROM f LEFT JOIN d USING (commodity, market, i)
), t AS (SELECT *, CASE WHEN average IS NOT NULL AND k >= 4 THEN CASE WHEN scale IS NOT NULL THEN (average - c) / scale WHEN average <> c THEN 'infinity'::DOUBLE END END AS score,
    coalesce(low > high, false) OR coalesce(average < low, false) OR coalesce(average > high, false) AS is_impossible FROM s
), u AS (SELECT *, coalesce(abs(score) > {threshold} AND CASE WHEN c = 0 THEN average <> 0 ELSE abs(average - c) / abs(c) >= 0.1 END, false) AS is_anomaly FROM t)
SELECT commodity, market, observed_on::VARCHAR AS observed_on, average, CASE WHEN NOT isinf(score) THEN round(score, 6) END AS score, is_anomaly, is_impossible
FROM u {'WHERE is_anomaly OR is_impossible' if flagged else ''}"""


def _flagged(facts: DataFrame, config: RobustConfig, only: bool, chunk: int | None = None) -> DataFrame:
    out = robust.anomalies(robust.flag_series(facts, config, chunk=chunk), only)
    return out.select("commodity", "market", "observed_on", "average", F.round("score", 6).alias("score"), "is_anomaly", "is_impossible")


@query(_anomaly_sql(b.OBSERVATIONS_SQL, 9, 3.5, True))
def anomalies_default(spark, sf):
    return _flagged(b.observations(spark, sf), RobustConfig(), True)


@query(_anomaly_sql(b.SHIPMENTS_SQL, 7, 3.0, True))
def anomalies_in_chunks(spark, sf):
    """Series in chunks of a few points, as long ones would be."""
    return _flagged(b.shipments(spark, sf), RobustConfig(window=7, threshold=3.0), True, chunk=7)


@query(_anomaly_sql(b.OBSERVATIONS_SQL, 5, 2.0, True))
def anomalies_w5_t2(spark, sf):
    return _flagged(b.observations(spark, sf), RobustConfig(window=5, threshold=2.0), True)


@query(_anomaly_sql(b.OBSERVATIONS_SQL, 8, 3.5, False))
def anomalies_full_series(spark, sf):
    return _flagged(b.observations(spark, sf), RobustConfig(window=8), False)


@query(_anomaly_sql(b.SHIPMENTS_SQL, 9, 3.5, True))
def anomalies_shipments(spark, sf):
    return _flagged(b.shipments(spark, sf), RobustConfig(), True)


@query(f"""SELECT commodity, market, observed_on::VARCHAR AS observed_on, low, high, average, CASE WHEN low > high THEN 'low' WHEN average < low THEN 'average below' ELSE 'average above' END AS kind
FROM ({b.OBSERVATIONS_SQL}) WHERE average IS NOT NULL AND (average < low OR average > high)""")
def impossible_rows(spark, sf):
    found = b.observations(spark, sf).withColumn("why", robust.impossible_reason()).filter("why is not null")
    kind = F.when(F.col("why").startswith("low"), "low").when(F.col("why").contains("below"), "average below").otherwise("average above")
    return found.select("commodity", "market", "observed_on", "low", "high", "average", kind.alias("kind"))


@query(f"""WITH r AS (SELECT * FROM ({b.RUNS_SQL}) WHERE started_at::DATE = DATE '1998-07-20')
SELECT n_name AS slug, n_name AS name, count(run_id) AS runs, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'partial') AS partial,
  strftime(max(started_at), '%Y-%m-%d %H:%M:%S') AS last_run_at, strftime(max(started_at) FILTER (status = 'succeeded'), '%Y-%m-%d %H:%M:%S') AS last_success_at,
  coalesce(sum(rows_upserted), 0)::BIGINT AS rows_upserted, coalesce(sum(rows_quarantined), 0)::BIGINT AS rows_quarantined,
  CASE WHEN count(run_id) > 0 THEN count(*) FILTER (status = 'succeeded') / count(run_id) END AS success_rate
FROM nation LEFT JOIN r ON n_name = r.source GROUP BY n_name""")
def quality_sources(spark, sf):
    day = b.runs(spark, sf).filter(F.to_date("started_at") == F.lit(dt.date(1998, 7, 20)))
    return quality.per_source(b.sources(spark, sf), day)


@query(f"""WITH r AS ({b.RUNS_SQL})
SELECT n_name AS slug, n_name AS name, count(run_id) AS runs, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'partial') AS partial,
  strftime(max(started_at), '%Y-%m-%d %H:%M:%S') AS last_run_at, strftime(max(started_at) FILTER (status = 'succeeded'), '%Y-%m-%d %H:%M:%S') AS last_success_at,
  coalesce(sum(rows_upserted), 0)::BIGINT AS rows_upserted, coalesce(sum(rows_quarantined), 0)::BIGINT AS rows_quarantined,
  CASE WHEN count(run_id) > 0 THEN count(*) FILTER (status = 'succeeded') / count(run_id) END AS success_rate
FROM nation LEFT JOIN r ON n_name = r.source GROUP BY n_name""")
def quality_sources_all(spark, sf):
    return quality.per_source(b.sources(spark, sf), b.runs(spark, sf))


@query("""SELECT stage, count(*) AS rows, min(reason) AS example_reason FROM (
  SELECT CASE WHEN l_quantity < 5 THEN 'index' WHEN l_quantity < 15 THEN 'parse' ELSE 'alias' END AS stage, 'held: ' || l_returnflag || ' ' || l_linestatus AS reason FROM lineitem WHERE l_discount > 0.05) GROUP BY stage""")
def quality_quarantine(spark, sf):
    li = b.table(spark, sf, "lineitem").filter("l_discount > 0.05")
    stage = F.when(F.col("l_quantity") < 5, "index").when(F.col("l_quantity") < 15, "parse").otherwise("alias")
    return quality.per_stage(li.select(stage.alias("stage"), F.concat(F.lit("held: "), "l_returnflag", F.lit(" "), "l_linestatus").alias("reason")))


@query(f"""SELECT count(*) AS observations, count(*) FILTER (unavailable) AS unavailable, count(*) FILTER (average IS NOT NULL AND (average < low OR average > high)) AS impossible,
  min(observed_on)::VARCHAR AS first_on, max(observed_on)::VARCHAR AS last_on, count(DISTINCT commodity) AS commodities_observed FROM ({b.OBSERVATIONS_SQL})""")
def quality_totals(spark, sf):
    return quality.totals(b.observations(spark, sf))


@query(f"SELECT count(DISTINCT commodity) AS commodities_observed FROM ({b.SHIPMENTS_SQL})")
def commodities_observed(spark, sf):
    return b.shipments(spark, sf).agg(F.countDistinct("commodity").alias("commodities_observed"))


@query(f"SELECT commodity, count(*) AS observations, round(avg((average IS NULL)::INT), 9) AS null_rate FROM ({b.OBSERVATIONS_SQL}) GROUP BY commodity")
def null_rate(spark, sf):
    return quality.null_rate(b.observations(spark, sf)).withColumn("null_rate", F.round("null_rate", 9))


_FIRST = f"WITH h AS ({b.HISTORY_SQL}), x AS (SELECT *, first_value(fig) OVER (PARTITION BY market, commodity ORDER BY pos) AS f FROM h), s AS (SELECT *, min(pos) FILTER (fig <> f) OVER (PARTITION BY market, commodity) AS split FROM x)"


@query(f"{_FIRST} SELECT market, commodity, fig / 1.0 AS low, fig + 0.5 AS high FROM s WHERE split IS NULL AND pos = 1")
def collapse_settled(spark, sf):
    return state.collapse_duplicates(b.history(spark, sf)).settled.select("market", "commodity", "low", "high")


@query(f"{_FIRST} SELECT market, commodity, 1 + count(*) AS rows_rejected FROM s WHERE pos >= split GROUP BY ALL")
def collapse_conflicts(spark, sf):
    return state.collapse_duplicates(b.history(spark, sf)).conflicts.select("market", "commodity", "rows_rejected")


_CHAIN = f"WITH h AS ({b.HISTORY_SQL}), x AS (SELECT *, lag(fig) OVER (PARTITION BY market, commodity ORDER BY pos) AS was FROM h), ch AS (SELECT *, row_number() OVER (PARTITION BY market, commodity ORDER BY pos) - 1 AS revision_no, pos = max(pos) OVER (PARTITION BY market, commodity) AS is_current FROM x WHERE pos = 1 OR fig <> was)"


@query(f"{_CHAIN} SELECT market, commodity, revision_no, is_current, fig / 1.0 AS low FROM ch")
def revision_chain(spark, sf):
    return state.revision_chain(b.history(spark, sf), "position").select("market", "commodity", "revision_no", "is_current", "low")


@query(f"{_CHAIN} SELECT market, commodity, revision_no, fig / 1.0 AS low, fig + 0.5 AS high FROM ch WHERE is_current")
def current_state(spark, sf):
    return state.revision_chain(b.history(spark, sf), "position").filter("is_current").select("market", "commodity", "revision_no", "low", "high")


def _upserted(spark, sf):
    h = b.history(spark, sf)
    stored = state.collapse_duplicates(h).settled.withColumns({"revision_no": F.lit(0), "ingested_at": F.lit("2024-01-01").cast("timestamp")}).filter("market % 3 <> 0")
    # The batch repeats all keys; those of every fifth market have moved.
    moved = F.when(F.col("market") % 5 == 0, F.lit(1)).otherwise(F.lit(0)).cast("decimal(12,2)")
    return state.upsert(stored, h.withColumns({c: F.col(c) + moved for c in ("low", "high", "prevailing", "average")}))


@query(f"""{_FIRST}, k AS (SELECT market, commodity, any_value(split) AS split, count(*) AS n, count(*) FILTER (pos >= split) AS late FROM s GROUP BY ALL)
SELECT count(*) FILTER (split IS NULL AND market % 3 = 0) AS inserted, count(*) FILTER (split IS NULL AND market % 3 <> 0 AND market % 5 = 0) AS revised,
  (sum(n) FILTER (split IS NULL))::BIGINT - count(*) FILTER (split IS NULL AND (market % 3 = 0 OR market % 5 = 0)) AS unchanged,
  count(*) FILTER (split IS NOT NULL) AS conflicts, coalesce(sum(late + 1) FILTER (split IS NOT NULL), 0)::BIGINT AS rejected FROM k""")
def upsert_outcome(spark, sf):
    return _upserted(spark, sf).outcome


@query(f"{_FIRST} SELECT market, commodity, CASE WHEN market % 3 <> 0 AND market % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS revision_no, fig + CASE WHEN market % 5 = 0 THEN 1.0 ELSE 0.0 END AS low FROM s WHERE split IS NULL AND pos = 1")
def upsert_state(spark, sf):
    return _upserted(spark, sf).state.select("market", "commodity", "revision_no", "low")


@query("""WITH r AS (SELECT p_type AS g, p_name AS n, l_returnflag AS s, l_suppkey % 12 AS sheet FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT g, n, s, count(DISTINCT sheet) AS sheets FROM r GROUP BY ALL)
SELECT g AS "group", n AS commodity, s AS specification, sheets, lower(g) || '-' || replace(n, ' ', '-') || '-' || lower(s) AS slug FROM c WHERE sheets >= (SELECT count(DISTINCT sheet) // 2 + 1 FROM r)""")
def attestation_seed(spark, sf):
    li, part = b.table(spark, sf, "lineitem"), b.table(spark, sf, "part")
    rows = li.join(part, li["l_partkey"] == part["p_partkey"]).select(F.col("p_type").alias("group"), F.col("p_name").alias("commodity"), F.col("l_returnflag").alias("specification"), (F.col("l_suppkey") % 12).alias("sheet"))
    return resolve.attested(rows)


def _resolved(spark, sf):
    """Parts as sheet rows, against a vocabulary that lacks some and records another unit for others."""
    part = b.table(spark, sf, "part")
    rows = part.select("p_partkey", F.col("p_type").alias("group"), F.upper("p_name").alias("commodity"), F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ")).alias("specification"), F.lit("kg").alias("unit"))
    known = part.select("p_type", "p_name", "p_brand").distinct().filter("substring(p_brand, 7, 1) <> '3'")
    key = text.alias_key(F.col("p_type"), F.col("p_name"), F.col("p_brand"))
    slug = text.slugify(F.col("p_type"), F.col("p_name"), F.col("p_brand"))
    dims = known.select(key.alias("alias_key"), slug.alias("canonical_slug"), F.when(F.col("p_brand") == "Brand#4", "bag").otherwise("kg").alias("unit"))
    return resolve.resolve_commodities(rows, dims, dims)


@query("""SELECT p_partkey, lower(p_type) || ' | ' || lower(p_name) || ' | ' || lower(p_brand) AS alias_key, lower(p_type) || '-' || replace(p_name, ' ', '-') || '-' || replace(lower(p_brand), '#', '-') AS canonical_slug
FROM part WHERE substr(p_brand, 7, 1) <> '3' AND p_brand <> 'Brand#4'""")
def alias_resolution(spark, sf):
    return _resolved(spark, sf).filter("alias_reason is null").select("p_partkey", "alias_key", "canonical_slug")


@query("""SELECT p_partkey, CASE WHEN substr(p_brand, 7, 1) = '3' THEN 'no alias for ''' || lower(p_type) || ' | ' || lower(p_name) || ' | ' || lower(p_brand) || ''''
  ELSE 'unit ''kg'' does not match ''bag'' recorded for ''' || lower(p_type) || '-' || replace(p_name, ' ', '-') || '-' || replace(lower(p_brand), '#', '-') || '''' END AS reason
FROM part WHERE substr(p_brand, 7, 1) = '3' OR p_brand = 'Brand#4'""")
def alias_unresolved(spark, sf):
    return _resolved(spark, sf).filter("alias_reason is not null").select("p_partkey", F.col("alias_reason").alias("reason"))


@query(f"SELECT r_regionkey::VARCHAR AS psgc_code, r_name AS name, count(*) AS markets FROM region JOIN ({b.MARKETS_SQL}) m ON r_regionkey::VARCHAR = region_psgc_code GROUP BY ALL")
def region_options(spark, sf):
    return pages.region_options(b.regions(spark, sf), b.markets(spark, sf))


@query(f"""WITH o AS (SELECT * FROM ({b.OBSERVATIONS_SQL}) WHERE commodity = 'click' AND average IS NOT NULL), m AS (SELECT DISTINCT market FROM o ORDER BY market LIMIT 6)
SELECT observed_on::VARCHAR AS observed_on, market, average FROM o WHERE market IN (SELECT market FROM m)""")
def price_pivot(spark, sf):
    """The pivot folded back to rows: its columns are the markets of the data."""
    wide = pages.price_pivot(b.observations(spark, sf), "click")
    return wide.unpivot("observed_on", wide.columns[1:], "market", "average").filter("average is not null").withColumn("market", F.col("market").cast("long"))


def _cells(spark, sf):
    """Line items as cells of sheets: an order is a file, ten lines a page; some group cells are blank or covered."""
    li, part = b.table(spark, sf, "lineitem"), b.table(spark, sf, "part")
    rows = li.join(part, li["l_partkey"] == part["p_partkey"]).withColumn("k", F.expr("l_orderkey * 7 + l_linenumber * 3 + l_partkey"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    w = F.row_number().over(b_window("file", order))
    group = F.when(F.expr("k % 3 = 0"), F.col("p_type")).when(F.expr("k % 3 = 1"), F.lit("")).otherwise(F.lit(None))
    rows = rows.withColumn("file", F.expr("l_orderkey div 40")).withColumn("row_no", w)
    price = F.col("l_quantity").cast("int").cast("string")
    cells = F.array(group, F.col("p_name"), F.lit("x"), F.lit("kg"), price, price, price, price)
    return rows.select(F.col("file").cast("string").alias("file_sha"), F.col("row_no"), F.expr("int((row_no - 1) div 10)").alias("page"), cells.alias("cells"))


def b_window(by: str, order: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(*order)


@query("""WITH r AS (SELECT (l_orderkey // 40)::VARCHAR AS file_sha, p_type, (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 3 AS k,
    row_number() OVER (PARTITION BY l_orderkey // 40 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS row_no FROM lineitem JOIN part ON l_partkey = p_partkey
), e AS (SELECT *, CASE WHEN k = 0 THEN p_type WHEN k = 1 AND (row_no - 1) % 10 <> 0 THEN
    first_value(CASE WHEN k = 0 THEN p_type END IGNORE NULLS) OVER (PARTITION BY file_sha ORDER BY row_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS ev FROM r)
SELECT file_sha, row_no, last_value(ev IGNORE NULLS) OVER (PARTITION BY file_sha ORDER BY row_no) AS "group" FROM e""")
def group_fill(spark, sf):
    return sheets.with_groups(sheets.classified(_cells(spark, sf))).select("file_sha", "row_no", "group")


PATTERN = r"^https?://[^/]+/[A-Za-z]"
_LINKS = r"""WITH a AS (SELECT page_id, url, generate_subscripts(m, 1) - 1 AS position, unnest(m) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS m FROM pages)),
t AS (SELECT page_id, position, CASE WHEN href LIKE 'http%' THEN href ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || href END AS u FROM a WHERE href LIKE 'http%' OR href LIKE '/%'),
c AS (SELECT page_id, position, lower(regexp_extract(u, '^(https?://[^/?#]+)', 1)) || regexp_extract(u, '^https?://[^/?#]+([^#]*)', 1) AS target FROM t)"""


#: The reason why a text without figures is no date: it has no month, or no year.
_MONTHS = "'" + "', '".join([*MONTHS, *SHORT]) + "'"
_READ = "CASE WHEN len(list_filter(string_split_regex(lower({x}), '[-_/.,()\\[\\]:;|+\\s]+'), lambda w: w IN (" + _MONTHS + "))) > 0 THEN 'no four-digit year found' ELSE 'no month name found' END"


@query(f"{_LINKS} SELECT page_id, position, target FROM c WHERE regexp_matches(target, '{PATTERN}')")
def index_candidates(spark, sf):
    return listing.candidates(listing.simple_anchors(b.table(spark, sf, "pages")), PATTERN).select("page_id", "position", "target")


@query(f"{_LINKS} SELECT arg_min(page_id, (page_id, position)) AS page_id, arg_min(position, (page_id, position)) AS position, target, count(*) AS times FROM c WHERE regexp_matches(target, '{PATTERN}') GROUP BY target")
def index_dedup(spark, sf):
    found = listing.candidates(listing.simple_anchors(b.table(spark, sf, "pages")), PATTERN)
    return listing.first_sightings(found).select("page_id", "position", "target", "times")


@query(rf"""{_LINKS}, f AS (SELECT target, count(*) AS times FROM c WHERE regexp_matches(target, '{PATTERN}') GROUP BY target), x AS (
  SELECT target, times, arg_min(t, (page_id, position)) AS t FROM f JOIN (
    SELECT c.target, c.page_id, c.position, l.t FROM c JOIN (SELECT page_id, generate_subscripts(m, 1) - 1 AS position, unnest(m) AS t FROM (
      SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href="[^"]*"[^>]*>([^<]*)', 1) AS m FROM pages)) l ON c.page_id = l.page_id AND c.position = l.position) USING (target) GROUP BY ALL
), w AS (SELECT target, times, {_READ.format(x="t")} AS r1, {_READ.format(x="regexp_replace(regexp_extract(target, '[^/]*$'), '(.)[.][^.]*$', '$1')")} AS r2 FROM x)
SELECT target, times, NULL AS observed_on, NULL AS date_source, false AS is_revision, false AS month_was_corrected, 'no date in link text (' || r1 || ') nor in filename (' || r2 || ')' AS reason FROM w""")
def index_entries(spark, sf):
    """Every link of every page by the full reader, with its date or the reason why it has none."""
    judged = listing.entries(listing.candidates(listing.anchors(b.table(spark, sf, "pages")), PATTERN))
    return judged.select("target", "times", "observed_on", "date_source", "is_revision", "month_was_corrected", "reason")


@query("SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS canonical, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin FROM pages")
def url_canonical(spark, sf):
    p = b.table(spark, sf, "pages")
    return p.select("page_id", text.canonical_url(F.col("url")).alias("canonical"), text.origin_of(F.col("url")).alias("origin"))


@query("SELECT sha256(html) AS sha256, substr(sha256(html), 1, 2) AS shard1, substr(sha256(html), 3, 2) AS shard2, count(*) AS copies FROM pages GROUP BY ALL")
def content_address(spark, sf):
    p = b.table(spark, sf, "pages").withColumn("content", F.col("html").cast("binary"))
    return p.select(*rawstore.address()).groupBy("sha256", "shard1", "shard2").agg(F.count("*").alias("copies"))


@query("""WITH p AS (SELECT lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS u, sha256(html) AS s FROM pages)
SELECT u AS url, count(DISTINCT s) AS versions, min(s) AS least, max(s) AS greatest FROM p GROUP BY u HAVING count(DISTINCT s) > 1""")
def cache_conflicts(spark, sf):
    """Pages filed under their host alone, so that hosts with several pages conflict."""
    p = b.table(spark, sf, "pages")
    return rawstore.conflicts(p.select(text.origin_of(F.col("url")).alias("url"), F.col("html").cast("binary").alias("content")))


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS target FROM pages)
SELECT page_id, target FROM p WHERE target NOT IN (SELECT target FROM p WHERE page_id % 2 = 0)""")
def fetch_once(spark, sf):
    """Odd pages against a manifest of the even ones."""
    p = b.table(spark, sf, "pages").withColumns({"content": F.col("html").cast("binary"), "fetched_at": F.col("page_id"), "content_type": F.lit("text/html"), "http_status": F.lit(200)})
    named = p.select("page_id", text.canonical_url(F.col("url")).alias("target"))
    return rawstore.to_fetch(named, rawstore.manifest_of(p.filter("page_id % 2 = 0"))).select("page_id", "target")


@query("""SELECT o_orderkey AS page_id, strftime(o_orderdate, '%Y-%m-%d') AS observed_on, row_number() OVER (ORDER BY o_orderdate::DATE, o_orderkey) AS file_seq
FROM orders WHERE o_orderdate::DATE >= DATE '1998-07-06'""")
def lookback_entries(spark, sf):
    o = b.table(spark, sf, "orders")
    judged = o.select(F.col("o_orderkey").alias("page_id"), F.lit(0).alias("position"), F.to_date("o_orderdate").alias("observed_on"), F.lit(None).cast("string").alias("reason"))
    return listing.lookback(judged, dt.date(1998, 7, 20)).select("page_id", "observed_on", "file_seq")


@query(r"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))) AS collapsed FROM documents")
def collapse_text(spark, sf):
    d = b.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(text.collapse(F.col("text"))).alias("collapsed"))


@query("""SELECT o_orderkey, 'Daily-Price-Index-' || CASE WHEN fixed THEN substr(m, 1, 3) || substr(m, 3) ELSE m END || strftime(o_orderdate, '-%-d-%Y') AS said, o_orderdate::DATE::VARCHAR AS expected,
  o_orderdate::DATE::VARCHAR AS read, NULL AS reason, fixed AS corrected FROM (SELECT *, strftime(o_orderdate, '%B') AS m, length(strftime(o_orderdate, '%B')) > 5 AND o_orderkey % 3 = 0 AS fixed FROM orders)""")
def read_date_fuzzy(spark, sf):
    """Order dates written by hand, with some months misspelled: every one is read back."""
    o = b.table(spark, sf, "orders")
    month = F.date_format("o_orderdate", "MMMM")
    typo = F.when((F.length(month) > 5) & (F.col("o_orderkey") % 3 == 0), F.concat(F.substring(month, 1, 3), F.substring(month, 3, 20))).otherwise(month)
    said = F.concat(F.lit("Daily-Price-Index-"), typo, F.lit("-"), F.date_format("o_orderdate", "d"), F.lit("-"), F.date_format("o_orderdate", "yyyy"))
    read = o.select("o_orderkey", F.to_date("o_orderdate").alias("expected"), said.alias("said")).withColumn("r", read_date(F.col("said")))
    return read.select("o_orderkey", "said", "expected", F.col("r.value").alias("read"), F.col("r.reason").alias("reason"), F.col("r.corrected").alias("corrected"))


@query("SELECT page_id, CASE WHEN s IS NULL OR s = 429 OR s >= 500 THEN 'unreachable' WHEN s >= 400 THEN 'unavailable' WHEN page_id % 7 <> 0 THEN 'parsed' ELSE 'unreachable' END AS policy FROM (SELECT page_id, [200, 404, 429, 503, NULL, 301, 204][1 + page_id % 7] AS s FROM pages) WHERE s IS NULL OR s <> 301")
def robots_policy(spark, sf):
    p = b.table(spark, sf, "pages").select("page_id", F.expr("array(200, 404, 429, 503, null, 301, 204)[int(page_id % 7)]").alias("s"))
    return p.filter("s is null or s <> 301").select("page_id", text.robots_policy(F.col("s"), F.col("page_id") % 7 != 0).alias("policy"))
