"""The given tables seen as the price platform's.

A small dense star comes from ``events`` (commodity = event type, market = user, one row a day), a large gappy one from
``lineitem`` with ``part`` and ``supplier``. Averages are exact: integer cents, rounded half up. So that blanks and impossible
rows occur, some rows are changed by a rule on their key, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
INPUT_TYPE = "PROMO"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(cents: str) -> Column:
    return (F.col(cents).cast("decimal(14,0)") / F.lit(100).cast("decimal(3,0)")).cast(MONEY)


def _prices(grouped: DataFrame) -> DataFrame:
    """Adds the blanks and typos, and turns cents into money."""
    k = F.expr("(market * 31 + datediff(observed_on, date'2024-01-01') + 100000) % 1000")
    blank, typo = k % 29 == 0, k % 23 == 0
    average = F.expr("(2 * s + c) div (2 * c)")
    out = grouped.withColumns({"_blank": blank, "_typo": typo, "_avg": average})
    out = out.withColumn("_avg", F.when(F.col("_typo"), F.expr("_avg div 10")).otherwise(F.col("_avg")))
    cols = {name: F.when(~F.col("_blank"), F.col(src)) for name, src in (("low", "lo"), ("high", "hi"), ("prevailing", "hi"), ("average", "_avg"))}
    return out.withColumns(cols).select(
        F.lit("events").alias("source"), "commodity", "market", "observed_on", *[money(c).alias(c) for c in cols], F.col("_blank").alias("unavailable")
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("commodity"), F.col("user_id").alias("market"), F.to_date("ts").alias("observed_on"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return _prices(e.groupBy("commodity", "market", "observed_on").agg(F.min("cents").alias("lo"), F.max("cents").alias("hi"), F.sum("cents").alias("s"), F.count("*").alias("c")))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("market"), F.to_date("l_shipdate").alias("observed_on"), F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long").alias("cents"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_type", "p_brand").alias("commodity"))
    joined = li.join(part, "l_partkey")
    return _prices(joined.groupBy("commodity", "market", "observed_on").agg(F.min("cents").alias("lo"), F.max("cents").alias("hi"), F.sum("cents").alias("s"), F.count("*").alias("c")))


def commodities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_type", "p_brand")
    return p.groupBy(name.alias("name"), F.when(F.col("p_type") == INPUT_TYPE, "FERTILIZER").otherwise(F.col("p_type")).alias("group")).agg(
        F.min("p_partkey").alias("id"), F.min("p_name").alias("specification"), F.lit("kg").alias("unit")
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    return joined.select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").cast("string").alias("region_psgc_code"), F.col("s_name").alias("name"), F.col("n_name").alias("municipality"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("psgc_code"), F.col("r_name").alias("name"), F.lit("region").alias("level"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("slug"), F.col("n_name").alias("name"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "succeeded").otherwise("partial")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return joined.select(
        F.col("o_orderkey").alias("run_id"), F.col("n_name").alias("source"), status.alias("status"), F.col("o_orderdate").alias("started_at"),
        (F.col("o_orderkey") % 97).alias("rows_upserted"), (F.col("o_orderkey") % 7).alias("rows_quarantined"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sightings of a price, some keys several times: the position is the order within a key."""
    li = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    position = F.struct(F.to_date("l_shipdate").alias("d"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), cents.alias("c"))
    # Few distinct figures, so that repeats of a key often agree.
    out = li.withColumns({"lo": F.col("l_quantity").cast("long") % 3 * 100, "hi": F.col("l_quantity").cast("long") % 3 * 100 + 50})
    return out.select(
        F.lit("lines").alias("source"), F.col("l_orderkey").alias("market"), F.col("l_linenumber").cast("string").alias("commodity"), F.lit("1995-01-01").cast("date").alias("observed_on"),
        money("lo").alias("low"), money("hi").alias("high"), money("hi").alias("prevailing"), money("lo").alias("average"), F.lit(False).alias("unavailable"),
        position.alias("position"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("source_file_sha256"),
    )


PRICES_SQL = """
SELECT source, commodity, market, observed_on, CASE WHEN k % 29 <> 0 THEN lo / 100.0 END AS low, CASE WHEN k % 29 <> 0 THEN hi / 100.0 END AS high,
       CASE WHEN k % 29 <> 0 THEN hi / 100.0 END AS prevailing,
       CASE WHEN k % 29 <> 0 THEN (CASE WHEN k % 23 = 0 THEN a // 10 ELSE a END) / 100.0 END AS average, k % 29 = 0 AS unavailable
FROM (SELECT *, (2 * s + c) // (2 * c) AS a, (market * 31 + date_diff('day', DATE '2024-01-01', observed_on) + 100000) % 1000 AS k FROM
  (SELECT 'events' AS source, commodity, market, observed_on, min(cents) AS lo, max(cents) AS hi, sum(cents)::BIGINT AS s, count(*) AS c FROM ({rows}) GROUP BY ALL))"""
OBSERVATIONS_SQL = PRICES_SQL.format(rows="SELECT event_type AS commodity, user_id AS market, ts::DATE AS observed_on, round(value * 100)::BIGINT AS cents FROM events")
SHIPMENTS_SQL = PRICES_SQL.format(
    rows="SELECT p_type || ' ' || p_brand AS commodity, l_suppkey AS market, l_shipdate::DATE AS observed_on, round(l_extendedprice / l_quantity * 100)::BIGINT AS cents FROM lineitem JOIN part ON l_partkey = p_partkey"
)
COMMODITIES_SQL = "SELECT p_type || ' ' || p_brand AS name, CASE WHEN p_type = 'PROMO' THEN 'FERTILIZER' ELSE p_type END AS \"group\", min(p_partkey) AS id, min(p_name) AS specification, 'kg' AS unit FROM part GROUP BY ALL"
MARKETS_SQL = "SELECT s_suppkey AS id, n_regionkey::VARCHAR AS region_psgc_code, s_name AS name, n_name AS municipality FROM supplier JOIN nation ON s_nationkey = n_nationkey"
RUNS_SQL = """SELECT o_orderkey AS run_id, n_name AS source, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'partial' END AS status,
  o_orderdate AS started_at, o_orderkey % 97 AS rows_upserted, o_orderkey % 7 AS rows_quarantined
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
HISTORY_SQL = """SELECT l_orderkey AS market, l_linenumber::VARCHAR AS commodity, (l_quantity::BIGINT % 3)::BIGINT AS fig,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate::DATE, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS pos FROM lineitem"""
