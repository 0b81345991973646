"""Pages with totals, pages by seek, case folding, the order of files."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import pages, quality
from marketloom.schemas import PageRequest
from marketloom.sources import listing

SF = "/root/testdata/sf0.001"


def test_folds_every_code_point_as_python_does(spark):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rows = ["".join(every[i : i + 500]) for i in range(0, len(every), 500)] + ["", "Straße ΣΑΣ İ ŉ ﬁ 𐐀A", "ASCII Only\n"]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", text.casefold(F.col("t")).alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: t.casefold() for i, t in enumerate(rows)}
    key = spark.createDataFrame([("  GROẞE  ", "ﬀ", None)], "g string, n string, s string").select(text.alias_key(F.col("g"), F.col("n"), F.col("s"))).first()[0]
    assert key == "grosse | ff | "


def rows_of(spark, n=120):
    rnd = random.Random(n)
    rows = [(i, rnd.choice([None, 1, 2, 3]), rnd.choice([None, "a", "b"])) for i in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "i int, k int, s string")


@pytest.mark.parametrize("order", [["k", "s", "i"], ["-k", "s", "-i"], ["-s", "-k", "i"]])
def test_pages_by_seek_are_pages_by_offset(spark, order):
    df = rows_of(spark)
    by = [F.desc(o[1:]) if o[0] == "-" else F.asc(o) for o in order]
    want, last, got = df.orderBy(*by).collect(), None, []
    while some := pages.seek(df, order, last, 23).collect():
        got += some
        last = some[-1].asDict()
    assert got == want


def test_a_page_and_its_total_come_from_one_job(spark, tmp_path):
    rows_of(spark).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").filter("k is not null")
    spark.sparkContext.setJobGroup("paged", "")
    rows, total = pages.page_and_total(df, ["k", "i"], PageRequest(10, 20))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("paged")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert total == df.count() and rows == df.orderBy("k", "i").collect()[20:30] and len(jobs) == 1


def test_files_are_numbered_over_all_days(spark):
    day = dt.date(2026, 7, 10)
    rows = [(2, 0, day, None), (1, 5, day, None), (1, 4, day, None), (9, 9, day - dt.timedelta(days=3), None), (3, 0, day + dt.timedelta(days=40), None), (4, 0, day, "no"), (5, 0, day - dt.timedelta(days=20), None)]
    got = listing.lookback(spark.createDataFrame(rows, "page_id long, position int, observed_on date, reason string"), day).collect()
    assert [(r.page_id, r.position, r.file_seq) for r in got] == [(9, 9, 1), (1, 4, 2), (1, 5, 3), (2, 0, 4), (3, 0, 5)]


def test_files_found_by_lookback_revise_each_other_in_order(spark):
    """Discover, then upsert: two days' files with one key, of which the later file counts, though each day has its own first file."""
    from marketloom.operators import state
    from marketloom.schemas import TABLES

    from .test_state import batch

    day = dt.date(2026, 7, 10)
    found = [(7, 0, day - dt.timedelta(days=1), None), (8, 0, day - dt.timedelta(days=1), None), (2, 0, day, None)]
    files = listing.lookback(spark.createDataFrame(found, "page_id long, position int, observed_on date, reason string"), day).select(F.col("page_id").cast("string").alias("source_file_sha256"), "file_seq")
    rows = batch(spark, [(1, "10.00", "7"), (1, "11.00", "8"), (1, "12.00", "2"), (1, "12.00", "2")]).join(files, "source_file_sha256")
    up = state.upsert_files(spark.createDataFrame([], TABLES["price_observations"]), rows)
    assert [(str(r.average), r.revision_no) for r in up.state.collect()] == [("12.00", 2)] and up.outcome.first().conflicts == 0
    assert sorted((str(r.average), r.revision_no) for r in up.revisions.collect()) == [("10.00", 0), ("11.00", 1)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_runs_are_summed_before_they_join(spark):
    sources = spark.createDataFrame([("a", "A")], "slug string, name string")
    runs = spark.createDataFrame([("a", "failed", "2024", 1, None)], "source string, status string, started_at string, rows_upserted int, rows_quarantined int")
    plan = quality.per_source(sources, runs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
    (r,) = quality.per_source(sources, runs).collect()
    assert (r.runs, r.rows_quarantined, r.success_rate) == (1, 0, 0.0)
