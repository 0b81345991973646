"""Queries over price sheets that Spark makes of the given tables: cells, headers, one whole ingest, dimensions and the store.

A file is forty orders; its rows are their line items. Some files lack a header, a known province or a market, or lie in the future, and some
rows a price, a unit or a sensible order of prices, by rules on their keys that both engines know.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dates import read_date
from ..operators import ingest, movers, pages, quality, resolve, robust, state
from ..schemas import COLUMN_HEADER, PageRequest, RobustConfig, TABLES
from ..sources import listing, rawstore, sheets
from . import bridge as b
from .registry import PRICE_COLUMNS, query

TODAY = dt.date(2024, 1, 1)
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def _lines(spark, sf) -> DataFrame:
    li, part = b.table(spark, sf, "lineitem"), b.table(spark, sf, "part")
    rows = li.join(part, li["l_partkey"] == part["p_partkey"]).withColumns({"k": F.expr("l_orderkey * 7 + l_linenumber * 3 + l_partkey"), "file": F.expr("l_orderkey div 40"), "q": F.col("l_quantity").cast("int")})
    return rows.withColumn("row_no", F.row_number().over(Window.partitionBy("file").orderBy(*ORDER)))


def _cells(spark, sf) -> DataFrame:
    rows = _lines(spark, sf)
    group = F.expr("case k % 3 when 0 then p_type when 1 then '' end")
    high = F.expr("if(k % 17 = 0, '', string(if(k % 11 = 0, q - 1, q)))")
    low = F.expr("if(k % 17 = 0, '', if(k % 13 = 0, 'n/a', string(q)))")
    unit = F.expr("if(k % 19 = 0, ' ', 'Kg')")
    cells = F.array(group, F.col("p_name"), F.lit("x"), unit, low, high, high, low)
    data = rows.select(F.col("file").cast("string").alias("file_sha"), "row_no", F.expr("int((row_no - 1) div 10)").alias("page"), cells.alias("cells"))
    head = F.array(*[F.lit(c.title()) for c in COLUMN_HEADER])
    heads = _files(spark, sf).filter("file % 10 <> 3").select(F.col("file").cast("string").alias("file_sha"), F.lit(0).alias("row_no"), F.lit(0).alias("page"), head.alias("cells"))
    return data.union(heads)


def _files(spark, sf) -> DataFrame:
    return b.table(spark, sf, "lineitem").select(F.expr("l_orderkey div 40").alias("file")).distinct()


def _headers(spark, sf) -> DataFrame:
    day = F.expr("date_add(if(file % 9 = 0, date'2031-01-01', date'2001-01-01'), int(file % 300))")
    lines = F.array_compact(F.array(
        F.expr("concat('Province: ', if(file % 7 = 0, 'Atlantis', concat('Province of NATION_', file % 25)))"),
        F.expr("concat('Municipality/C : ', if(file % 2 = 1, 'TOWN  ', 'Town '), file % 5)"),
        F.expr("if(file % 8 = 5, null, 'Market Monitored: Public Market')"),
        F.concat(F.lit("Date of Monitoring: "), F.date_format(day, "MMMM d, yyyy")),
    ))
    texts = _files(spark, sf).select(F.col("file").cast("string").alias("file_sha"), F.array_join(lines, "\n").alias("text"))
    return sheets.sheet_headers(texts).withColumn("file_seq", F.col("file_sha").cast("long"))


def _dims(spark, sf) -> dict[str, DataFrame]:
    nation, part = b.table(spark, sf, "nation"), b.table(spark, sf, "part")
    place = F.col("n_nationkey").cast("string")
    triples = part.select("p_type", "p_name").distinct()
    slug = text.slugify(F.col("p_type"), F.col("p_name"), F.lit("x"))
    return {
        "regions": nation.select(place.alias("psgc_code"), F.col("n_name").alias("name"), F.lit("province").alias("level")),
        "markets": nation.select(F.col("n_nationkey").cast("long").alias("id"), place.alias("region_psgc_code"), F.lit("PUBLIC MARKET").alias("name"), F.lit("Town 0").alias("municipality")),
        "commodities": triples.select(slug.alias("canonical_slug"), F.when(F.col("p_name").startswith("blue"), "bag").otherwise("kg").alias("unit")),
        "commodity_aliases": triples.filter("p_name not like 'red%'").select(text.alias_key(F.col("p_type"), F.col("p_name"), F.lit("x")).alias("alias_key"), slug.alias("canonical_slug")),
    }


def _ingested(spark, sf) -> ingest.Ingest:
    empty = spark.createDataFrame([], TABLES["price_observations"])
    return ingest.ingest(_cells(spark, sf), _headers(spark, sf), empty, _dims(spark, sf), "sheets", "run", F.lit(TODAY), F.lit("2024-01-01").cast("timestamp"))


_ROWS = """WITH r AS (SELECT l_orderkey // 40 AS file, p_type, p_name, l_orderkey * 7 + l_linenumber * 3 + l_partkey AS k, l_quantity::INT AS q,
    row_number() OVER (PARTITION BY l_orderkey // 40 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS row_no FROM lineitem JOIN part ON l_partkey = p_partkey
), e AS (SELECT *, CASE WHEN k % 3 = 0 THEN p_type WHEN k % 3 = 1 AND (row_no - 1) % 10 <> 0 THEN
    first_value(CASE WHEN k % 3 = 0 THEN p_type END IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS ev FROM r
), g AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_no) AS grp,
    CASE WHEN k % 17 <> 0 AND k % 13 <> 0 THEN q END AS low, CASE WHEN k % 17 <> 0 THEN CASE WHEN k % 11 = 0 THEN q - 1 ELSE q END END AS high FROM e
), s AS (SELECT *, CASE WHEN file % 10 = 3 THEN 'no column header row' WHEN grp IS NULL THEN 'row appears before any commodity group heading' WHEN k % 17 <> 0 AND k % 13 = 0 THEN 'not a number: n/a'
    WHEN k % 19 = 0 THEN 'row has no unit' WHEN low > high THEN 'low ' || low || '.00 is above high ' || high || '.00' END AS reason FROM g
), f AS (SELECT DISTINCT file, CASE WHEN file % 7 = 0 THEN 'Atlantis' ELSE 'Province of NATION_' || file % 25 END AS province, CASE WHEN file % 2 = 1 THEN 'TOWN ' ELSE 'Town ' END || file % 5 AS municipality,
    CASE WHEN file % 8 <> 5 THEN 'Public Market' END AS market, CASE WHEN file % 9 = 0 THEN DATE '2031-01-01' ELSE DATE '2001-01-01' END + (file % 300)::INT AS day FROM r
), p AS (SELECT *, CASE WHEN market IS NULL OR file % 10 = 3 THEN 'parse' WHEN file % 7 = 0 OR day > DATE '2024-01-01' THEN 'validate' END AS stage,
    CASE WHEN market IS NULL THEN 'header has no Market Monitored' WHEN file % 10 = 3 THEN 'no column header row' WHEN file % 7 = 0 THEN 'province ''Atlantis'' is not a seeded region'
      WHEN day > DATE '2024-01-01' THEN 'sheet is dated ' || day || ', after the run date 2024-01-01' END AS why,
    CASE WHEN file % 5 = 0 THEN file % 25 ELSE ('0x' || substr(sha256((file % 25) || '|town ' || file % 5 || '|public market'), 1, 15))::BIGINT END AS market_id FROM f
), t AS (SELECT s.*, p.market_id, p.day, lower(grp) || ' | ' || lower(p_name) || ' | x' AS alias_key, lower(grp) || '-' || replace(lower(p_name), ' ', '-') || '-x' AS slug FROM s JOIN p ON s.file = p.file WHERE p.why IS NULL AND s.reason IS NULL
), v AS (SELECT DISTINCT p_type, p_name FROM part
), n AS (SELECT t.*, CASE WHEN v.p_type IS NULL THEN 'no alias for ''' || alias_key || '''' WHEN t.p_name LIKE 'blue%' THEN 'unit ''kg'' does not match ''bag'' recorded for ''' || slug || '''' END AS alias_reason
    FROM t LEFT JOIN v ON v.p_type = t.grp AND v.p_name = t.p_name AND v.p_name NOT LIKE 'red%'
), o AS (SELECT *, coalesce(low, -1) * 1000 + coalesce(high, -1) AS fig, row_number() OVER w AS pos, first_value(coalesce(low, -1) * 1000 + coalesce(high, -1)) OVER w AS f0 FROM n WHERE alias_reason IS NULL WINDOW w AS (PARTITION BY market_id, slug, day, file ORDER BY row_no)
), d AS (SELECT *, min(pos) FILTER (fig <> f0) OVER (PARTITION BY market_id, slug, day, file) AS split FROM o
), c AS (SELECT *, lag(fig) OVER w AS was, row_number() OVER w AS nth FROM d WHERE split IS NULL AND pos = 1 WINDOW w AS (PARTITION BY market_id, slug, day ORDER BY file)
), h AS (SELECT *, row_number() OVER w - 1 AS revision_no, lead(1) OVER w IS NULL AS is_current FROM c WHERE nth = 1 OR fig <> was WINDOW w AS (PARTITION BY market_id, slug, day ORDER BY file))"""


@query(f"""{_ROWS} SELECT file::VARCHAR AS file_sha, row_no, p_name AS commodity, grp AS "group", CASE WHEN k % 19 = 0 THEN '' ELSE 'kg' END AS unit, low::DOUBLE AS low, high::DOUBLE AS high, low::DOUBLE AS average,
  k % 17 = 0 AS unavailable, reason FROM s""")
def sheet_rows(spark, sf):
    return sheets.price_rows(_cells(spark, sf)).select("file_sha", "row_no", "commodity", "group", "unit", "low", "high", "average", "unavailable", F.col("reject_reason").alias("reason"))


@query(f"{_ROWS} SELECT file::VARCHAR AS file_sha, province, municipality, market, day::VARCHAR AS observed_on, CASE WHEN market IS NULL THEN 'header has no Market Monitored' END AS reason FROM f")
def sheet_headers(spark, sf):
    return _headers(spark, sf).select("file_sha", "province", "municipality", "market", "observed_on", F.col("reject_reason").alias("reason"))


@query(f"{_ROWS} SELECT file::VARCHAR AS file_sha, stage, why AS reason, CASE WHEN file % 7 <> 0 THEN (file % 25)::VARCHAR END AS psgc_code FROM p")
def sheet_placing(spark, sf):
    """Every file with its province, and why it is refused whole."""
    return ingest.placed_files(_cells(spark, sf), _headers(spark, sf), _dims(spark, sf)["regions"], F.lit(TODAY)).select("file_sha", "stage", "reason", "psgc_code")


@query(f"{_ROWS} SELECT file::VARCHAR AS file_sha, count(*) AS rows, count(*) FILTER (k % 17 = 0) AS unavailable FROM s WHERE reason IS NULL GROUP BY file")
def unavailable_per_sheet(spark, sf):
    return sheets.unavailable_per_sheet(sheets.price_rows(_cells(spark, sf)))


@query(f"{_ROWS} SELECT market_id AS market, slug AS commodity, day::VARCHAR AS observed_on, low::DOUBLE AS low, high::DOUBLE AS high, low::DOUBLE AS average, low IS NULL AS unavailable, revision_no, file::VARCHAR AS file_sha FROM h WHERE is_current")
def ingest_state(spark, sf):
    found = _ingested(spark, sf).upsert.state
    return found.select("market", "commodity", "observed_on", "low", "high", "average", "unavailable", "revision_no", F.col("source_file_sha256").alias("file_sha"))


@query(f"{_ROWS} SELECT market_id AS market, slug AS commodity, day::VARCHAR AS observed_on, low::DOUBLE AS low, revision_no, file::VARCHAR AS file_sha FROM h WHERE NOT is_current")
def ingest_revisions(spark, sf):
    return _ingested(spark, sf).upsert.revisions.select("market", "commodity", "observed_on", "low", "revision_no", F.col("source_file_sha256").alias("file_sha"))


@query(f"""{_ROWS}, x AS (SELECT market_id, slug, day, file, 1 + count(*) FILTER (pos >= split) AS m FROM d WHERE split IS NOT NULL GROUP BY ALL)
SELECT file::VARCHAR AS file_sha, stage, why AS reason FROM p WHERE why IS NOT NULL
UNION ALL SELECT s.file::VARCHAR, 'parse', s.reason FROM s JOIN p ON s.file = p.file WHERE why IS NULL AND s.reason IS NOT NULL
UNION ALL SELECT file::VARCHAR, 'alias', alias_reason FROM n WHERE alias_reason IS NOT NULL
UNION ALL SELECT file::VARCHAR, 'validate', m || ' rows in one batch resolve to commodity ' || slug || ' at market ' || market_id || ' on ' || day || ' with different figures' FROM x""")
def ingest_quarantine(spark, sf):
    return _ingested(spark, sf).quarantine.select(F.col("source_file_sha256").alias("file_sha"), "stage", "reason")


@query(f"""{_ROWS} SELECT (SELECT count(*) FROM p) AS files_seen, (SELECT count(why) FROM p) AS files_failed, (SELECT count(*) FROM h) AS rows_upserted,
  (SELECT count(why) FROM p) + (SELECT count(s.reason) FROM s JOIN p ON s.file = p.file WHERE why IS NULL) + (SELECT count(alias_reason) FROM n)
    + (SELECT count(*) FROM (SELECT DISTINCT market_id, slug, day, file FROM d WHERE split IS NOT NULL)) AS rows_quarantined,
  CASE WHEN (SELECT count(why) FROM p) > 0 THEN 'partial' ELSE 'succeeded' END AS status""")
def ingest_run(spark, sf):
    return ingest.run_summary(_ingested(spark, sf))


@query(f"{_ROWS} SELECT market_id AS id, (file % 25)::VARCHAR AS region_psgc_code, arg_min(municipality, file) AS municipality, 'Public Market' AS name FROM p WHERE why IS NULL AND file % 5 <> 0 GROUP BY ALL")
def market_create(spark, sf):
    """Markets met for the first time, in the spelling of the first file."""
    return _ingested(spark, sf).markets.select("id", "region_psgc_code", "municipality", "name")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 <> 4 THEN c_nationkey::VARCHAR END AS psgc_code FROM customer""")
def province_resolution(spark, sf):
    """Customers' nations as sheets would spell them."""
    c, n = b.table(spark, sf, "customer"), b.table(spark, sf, "nation")
    spelt = F.expr("case c_custkey % 5 when 0 then n_name when 1 then concat('  Province  of ', lower(n_name)) when 2 then upper(n_name) when 3 then concat('PROVINCE OF ', n_name, ' ') else concat(n_name, ' City') end")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", spelt.alias("province"))
    return resolve.resolve_provinces(rows, _dims(spark, sf)["regions"]).select("c_custkey", "psgc_code")


def _sheet_rows_resolved(spark, sf):
    good = sheets.price_rows(_cells(spark, sf)).filter("reject_reason is null")
    d = _dims(spark, sf)
    return resolve.resolve_commodities(good, d["commodity_aliases"], d["commodities"])


@query(f"""{_ROWS} SELECT count(*) AS rows, count(*) FILTER (v.p_type IS NOT NULL AND s.p_name NOT LIKE 'blue%') AS resolved, round(count(*) FILTER (v.p_type IS NOT NULL AND s.p_name NOT LIKE 'blue%') / count(*), 9) AS rate
FROM s LEFT JOIN v ON v.p_type = s.grp AND v.p_name = s.p_name AND v.p_name NOT LIKE 'red%' WHERE reason IS NULL""")
def resolution_rate(spark, sf):
    return resolve.resolution_rate(_sheet_rows_resolved(spark, sf)).withColumn("rate", F.round("rate", 9))


@query("""WITH r AS (SELECT lower(p_type) || ' | ' || lower(p_name) || ' | ' || lower(l_returnflag) AS alias_key, l_suppkey % 12 AS sheet FROM lineitem JOIN part ON l_partkey = p_partkey
), c AS (SELECT alias_key FROM r GROUP BY alias_key HAVING count(*) >= (SELECT count(DISTINCT sheet) // 2 + 1 FROM r)), a AS (SELECT DISTINCT lower(p_type) || ' | ' || lower(p_name) || ' | a' AS alias_key FROM part)
SELECT alias_key, 'missing' AS kind FROM (SELECT alias_key FROM c EXCEPT SELECT alias_key FROM a) UNION ALL SELECT alias_key, 'unattested' FROM (SELECT alias_key FROM a EXCEPT SELECT alias_key FROM c)""")
def seed_drift(spark, sf):
    """A seed that knows one specification of each part, against the sheets."""
    li, part = b.table(spark, sf, "lineitem"), b.table(spark, sf, "part")
    rows = li.join(part, li["l_partkey"] == part["p_partkey"]).select(F.col("p_type").alias("group"), F.col("p_name").alias("commodity"), F.col("l_returnflag").alias("specification"), (F.col("l_suppkey") % 12).alias("sheet"))
    aliases = part.select(text.alias_key(F.col("p_type"), F.col("p_name"), F.lit("A")).alias("alias_key")).distinct()
    return resolve.drift(aliases, rows)


@query("SELECT DISTINCT lower(p_type) || ' | ' || lower(p_name) || ' | x' AS alias_key, lower(p_type) || '-' || replace(p_name, ' ', '-') || '-x' AS canonical_slug FROM part WHERE p_name LIKE 'blue%'")
def aliases_dangling(spark, sf):
    part = b.table(spark, sf, "part").select("p_type", "p_name").distinct()
    slug = text.slugify(F.col("p_type"), F.col("p_name"), F.lit("x"))
    aliases = part.select(text.alias_key(F.col("p_type"), F.col("p_name"), F.lit("x")).alias("alias_key"), slug.alias("canonical_slug"))
    return resolve.dangling(aliases, part.filter("p_name not like 'blue%'").select(slug.alias("canonical_slug")))


def _seed_case(spark, sf):
    s = b.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("slug"), F.col("s_nationkey").cast("string").alias("region"))
    seed = s.select("slug", F.when(F.col("id") % 4 == 0, "moved").otherwise(F.col("region")).alias("region"))
    return s.filter("id % 3 <> 0"), seed


@query("SELECT s_name AS slug, CASE WHEN s_suppkey % 3 = 0 THEN 'inserted' WHEN s_suppkey % 4 = 0 THEN 'updated' ELSE 'unchanged' END AS kind FROM supplier")
def seed_changes(spark, sf):
    return resolve.seed_changes(*_seed_case(spark, sf), "slug", ["region"])


@query("""SELECT s_name AS slug, CASE WHEN s_suppkey % 4 = 0 THEN 'moved' ELSE s_nationkey::VARCHAR END AS region,
  CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey ELSE ('0x' || substr(sha256(s_name), 1, 15))::BIGINT END AS id FROM supplier""")
def seed_upsert(spark, sf):
    return resolve.seeded(*_seed_case(spark, sf), "slug", ["region"])


@query("""SELECT 'https://x.example/' || page_id AS url, sha256(html) AS sha256, CASE WHEN page_id % 5 = 0 THEN 'blob missing' ELSE 'content hashes to ' || sha256(html || '!') END AS problem
FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0""")
def manifest_verify(spark, sf):
    """A store of all pages in which every fifth blob is missing and every seventh has changed."""
    p = b.table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://X.example/"), "page_id", F.lit("#a")).alias("url"), F.col("html").cast("binary").alias("content"), F.col("page_id").alias("fetched_at"), F.lit("text/html").alias("content_type"), F.lit(200).alias("http_status"))
    held = p.filter("page_id % 5 <> 0").select(F.sha2("content", 256).alias("sha256"), F.expr("if(page_id % 7 = 0, cast(concat(cast(content as string), '!') as binary), content)").alias("content"))
    return rawstore.verify(rawstore.manifest_of(p), held)


@query(f"SELECT name, \"group\", id, specification, unit, lower(replace(name, ' ', '-')) AS canonical_slug, false AS is_agricultural_input FROM ({b.COMMODITIES_SQL}) WHERE lower(replace(replace(name, ' ', '-'), '#', '-')) = 'economy-brand-7'".replace("lower(replace(name, ' ', '-')) AS", "'economy-brand-7' AS"))
def commodity_by_slug(spark, sf):
    dim = b.commodities(spark, sf).withColumn("canonical_slug", text.slugify(F.col("name")))
    return pages.commodity(dim, "economy-brand-7")


@query(f"""SELECT {PRICE_COLUMNS}, c."group", c.specification, c.unit, m.name AS market_name, m.municipality, m.region_psgc_code, 'Shipments' AS source_name
FROM ({b.SHIPMENTS_SQL}) o JOIN ({b.COMMODITIES_SQL}) c ON c.name = commodity JOIN ({b.MARKETS_SQL}) m ON m.id = market WHERE region_psgc_code = '3' AND NOT unavailable AND observed_on >= DATE '1998-01-01'""")
def observations_presented(spark, sf):
    names = spark.createDataFrame([("events", "Shipments")], "slug string, name string")
    where = b.markets(spark, sf)
    found = pages.observations(b.shipments(spark, sf), date_from=dt.date(1998, 1, 1), region="3", markets=where)
    return pages.presented(found, b.commodities(spark, sf), where, names)


@query("""SELECT n_name AS slug, n_name AS name, count(*) OVER () AS total FROM nation ORDER BY slug""")
def sources_by_slug(spark, sf):
    s = b.sources(spark, sf)
    return s.orderBy("slug").withColumn("total", F.count("*").over(Window.partitionBy()))  # one short dimension


@query("SELECT r_regionkey::VARCHAR AS psgc_code, r_name AS name, 'region' AS level FROM region ORDER BY psgc_code")
def regions_by_code(spark, sf):
    return b.regions(spark, sf).orderBy("psgc_code")


def _filtered_anomalies_sql() -> str:
    from .registry import _anomaly_sql

    own = f"SELECT * FROM ({b.SHIPMENTS_SQL}) WHERE market IN (SELECT id FROM ({b.MARKETS_SQL}) WHERE region_psgc_code = '2') AND observed_on BETWEEN DATE '1994-01-01' AND DATE '1999-12-31'"
    return _anomaly_sql(own, 7, 3.0, True)


@query(_filtered_anomalies_sql())
def anomalies_region_dated(spark, sf):
    """Region and dates are filtered before the windows."""
    flagged = robust.flagged_observations(b.shipments(spark, sf), RobustConfig.requested(7, 3.0), region="2", markets=b.markets(spark, sf), date_from=dt.date(1994, 1, 1), date_to=dt.date(1999, 12, 31))
    out = robust.anomalies(flagged, True)
    return out.select("commodity", "market", "observed_on", "average", F.round("score", 6).alias("score"), "is_anomaly", "is_impossible")


@query(f"""WITH o AS ({b.OBSERVATIONS_SQL}), p AS (SELECT * FROM o WHERE average > 0 AND observed_on > (SELECT max(observed_on) FROM o) - INTERVAL 30 DAY),
m AS (SELECT commodity, market, arg_min(average, observed_on) AS f, arg_max(average, observed_on) AS l FROM p GROUP BY ALL HAVING count(*) >= 2)
SELECT commodity FROM m ORDER BY round(abs((l - f) * 100 / f), 9) DESC, commodity, market LIMIT 1""")
def default_commodity(spark, sf):
    return movers.default_commodity(b.observations(spark, sf))


@query(f"SELECT {PRICE_COLUMNS} FROM ({b.OBSERVATIONS_SQL}) WHERE commodity = 'view' AND observed_on >= DATE '2024-01-20' - 30 AND NOT unavailable ORDER BY observed_on, market, source LIMIT 500")
def chart_query(spark, sf):
    return pages.chart(b.observations(spark, sf), "view", 30, dt.date(2024, 1, 20))


@query("SELECT count(*) AS quarantined FROM lineitem WHERE l_discount > 0.05")
def quarantined_total(spark, sf):
    li = b.table(spark, sf, "lineitem").filter("l_discount > 0.05")
    return quality.quarantined_total(li.select(F.expr("if(l_quantity < 5, 'index', 'parse')").alias("stage"), F.col("l_returnflag").alias("reason")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, q.low, q.high, CASE WHEN q.low > q.high THEN 'low ' || printf('%.2f', q.low) || ' is above high ' || printf('%.2f', q.high) ELSE 'unavailable with prices' END AS reason
FROM (SELECT *, {'low': l_quantity, 'high': l_quantity - l_partkey % 2, 'u': l_suppkey % 9 = 0} AS q FROM lineitem) WHERE q.low > q.high OR q.u""")
def rows_invalid(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.expr(f"cast({x} as {b.MONEY}) as {c}") for c, x in (("low", "l_quantity"), ("high", "l_quantity - l_partkey % 2"), ("prevailing", "l_quantity"), ("average", "l_quantity"))], F.expr("l_suppkey % 9 = 0").alias("unavailable"))
    return state.valid(li)[1].select("l_orderkey", "l_linenumber", "l_partkey", "low", "high", F.col("invalid_reason").alias("reason"))


@query("""SELECT p_partkey, lower(p_name) AS place, CASE p_partkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'L' WHEN 2 THEN 'pc' ELSE 'crate' END AS unit, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey + 1000.25 END AS amount,
  CASE p_partkey % 5 WHEN 0 THEN 'not a number: -' END AS error, CASE p_partkey % 3 WHEN 0 THEN 'observed_on' WHEN 1 THEN 'municipality' END AS field, p_partkey || '.v2.pdf' AS filename, p_partkey || '.v2' AS stem FROM part""")
def text_rules(spark, sf):
    """Places, units, amounts, header labels and file names, written in the ways of sheets."""
    p = b.table(spark, sf, "part")
    amount = text.read_amount(F.expr("if(p_partkey % 5 = 0, '-', concat(' ', format_number(p_partkey + 1000.25, 2), '\n'))"))
    url = F.expr("concat('https://h.example/a b/', p_partkey, '.v2.pdf?x=/y.z#f')")
    return p.select(
        "p_partkey", text.normalise_place(F.concat(F.lit("Province OF "), F.upper("p_name"))).alias("place"),
        text.normalise_unit(F.expr("array(' KILO', 'Liters', 'pieces ', 'crate')[int(p_partkey % 4)]")).alias("unit"), amount["value"].alias("amount"), amount["error"].alias("error"),
        text.field_for(F.expr("array('Date of M', 'MUNICIPALITY', 'mark')[int(p_partkey % 3)]")).alias("field"), text.filename_of(url).alias("filename"), text.stem_of(text.filename_of(url)).alias("stem"),
    )


@query("""SELECT o_orderkey, '₱' || format('{:,.2f}', o_totalprice) AS price, strftime(o_orderdate, '%-d %b') AS short_day, strftime(o_orderdate, '%-d %B %Y') AS long_day,
  strftime(o_orderdate::DATE - 90, '%Y-%m-%d') AS from_day, CASE WHEN o_orderkey % 21 > 10 THEN '+' ELSE '' END || printf('%.1f', (o_orderkey % 21 - 10) / 2.0) || '%' AS change,
  o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' (' || o_orderstatus || ')' ELSE '' END AS label FROM orders""")
def display_texts(spark, sf):
    """Amounts, dates, changes and labels as they are shown."""
    o = b.table(spark, sf, "orders")
    return o.select(
        "o_orderkey", text.peso(F.col("o_totalprice").cast("decimal(14,2)")).alias("price"), text.short_date(F.col("o_orderdate")).alias("short_day"), text.long_date(F.col("o_orderdate")).alias("long_day"),
        text.days_ago(90, F.to_date("o_orderdate")).alias("from_day"), text.percent(F.expr("(o_orderkey % 21 - 10) / 2.0D")).alias("change"),
        text.commodity_label(F.col("o_orderpriority"), F.expr("if(o_orderkey % 2 = 0, o_orderstatus, if(o_orderkey % 3 = 0, '', null))")).alias("label"),
    )


_LISTED = """SELECT o_orderkey, o_orderdate::DATE AS day, o_orderkey % 4 AS form FROM orders"""


@query(f"""SELECT 'https://h.example/up/' || CASE form WHEN 2 THEN 'Revised-' ELSE '' END || 'index-' || CASE form WHEN 1 THEN strftime(day, '%B-%-d-%Y') WHEN 2 THEN strftime(day, '%B-%-d-%Y') ELSE 'n' || o_orderkey END || '-o' || o_orderkey || '.pdf' AS target,
  2 AS times, CASE WHEN form <> 3 THEN day::VARCHAR END AS observed_on, CASE form WHEN 0 THEN 'link_text' WHEN 3 THEN NULL ELSE 'filename' END AS date_source, form = 2 AS is_revision, false AS month_was_corrected,
  CASE WHEN form = 3 THEN 'no date in link text (no month name found) nor in filename (no month name found)' END AS reason FROM ({_LISTED})""")
def index_dated_entries(spark, sf):
    """A listing page for each order, with a link of each form twice: dated by its text, by its file, by the file of a revision, not at all."""
    name = F.expr("""concat(if(o_orderkey % 4 = 2, 'Revised-', ''), 'index-', if(o_orderkey % 4 in (1, 2), date_format(o_orderdate, 'MMMM-d-yyyy'), concat('n', o_orderkey)), '-o', o_orderkey, '.pdf')""")
    said = F.expr("if(o_orderkey % 4 = 0, concat('<b>', date_format(o_orderdate, 'd MMM'), '</b>&nbsp;', date_format(o_orderdate, 'yyyy')), 'Download &amp; print')")
    html = F.concat(F.lit("<p><A HREF='../up/"), name, F.lit("#top'>"), said, F.lit("<a href='/x'>x</a><a class=c href=\"HTTPS://H.example/up/"), name, F.lit("\">again"))
    made = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit("https://h.example/list/page.html").alias("url"), html.alias("html"))
    judged = listing.entries(listing.candidates(listing.anchors(made), r"\.pdf"))
    return judged.select("target", "times", "observed_on", "date_source", "is_revision", "month_was_corrected", "reason")


_WORDS = r"""SELECT DISTINCT lang, unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents WHERE text IS NOT NULL"""


def _words(spark, sf) -> DataFrame:
    d = b.table(spark, sf, "documents").filter("text is not null")
    return d.select("lang", F.explode(F.expr(r"regexp_extract_all(text, '\\p{L}+', 0)")).alias("word")).distinct()


@query(f"SELECT DISTINCT word FROM ({_WORDS}) WHERE lang = 'fr' ORDER BY word COLLATE FR, word LIMIT 300 OFFSET 1500")
def words_in_french_order(spark, sf):
    """A page of the words of all French texts, as a French reader would look them up."""
    words = _words(spark, sf).filter("lang = 'fr'").select("word").distinct()
    return pages.page(words, pages.in_locale(["word"], "fr"), PageRequest(300, 1500))


@query(f"SELECT lang AS stage, count(*) AS rows, arg_min(word, k) AS example_reason FROM (SELECT *, row_number() OVER (ORDER BY word COLLATE DE, word) AS k FROM ({_WORDS})) GROUP BY lang")
def stages_in_german_order(spark, sf):
    """The least word of each language in German order, as the example of a stage would be."""
    return quality.per_stage(_words(spark, sf).select(F.col("lang").alias("stage"), F.col("word").alias("reason")), "de")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_custkey FROM orders), e AS (SELECT o_custkey AS target, min(o_orderkey) AS first, count(*) AS times FROM o GROUP BY o_custkey)
SELECT sum(times)::BIGINT AS candidates, sum(times - 1)::BIGINT AS duplicates, count(*) FILTER (target % 6 <> 0) AS entries, count(*) FILTER (target % 6 = 0) AS rejected, count(*) FILTER (target % 6 = 0) / count(*) AS rejection_rate FROM e""")
def index_counters(spark, sf):
    """What a scrape says of itself: every order links its customer's file, and every sixth file has no date."""
    o = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("page_id"), F.lit(0).alias("position"), F.lit("").alias("link_text"))
    judged = listing.first_sightings(o).withColumn("reason", F.when(F.col("target") % 6 == 0, "no date"))
    return listing.counters(judged)


@query(f"""SELECT (SELECT count(*) FROM ({b.COMMODITIES_SQL})) AS seeded, (SELECT count(DISTINCT commodity) FROM ({b.SHIPMENTS_SQL}) WHERE market % 3 = 0) AS observed""")
def commodities_seeded_and_observed(spark, sf):
    return quality.coverage(b.commodities(spark, sf), b.shipments(spark, sf).filter("market % 3 = 0"))
