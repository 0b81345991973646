"""The tables at rest: months, commits, crashes, runs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from marketloom.operators import state
from marketloom.operators import store as stores
from marketloom.operators.store import Run, SourceRefused, Store, run_ingest
from marketloom.plans import sheet_queries

from .test_state import BATCH

SF = "/root/testdata/sf0.001"
NOW = lambda: F.lit("2026-08-01").cast("timestamp")  # noqa: E731  a Column needs a session


def batch(spark, rows):
    """rows: (day as text, average, file)."""
    from decimal import Decimal as D

    return spark.createDataFrame([("s", 2, "c", dt.date.fromisoformat(d), *[D(a)] * 4, False, f, i) for i, (d, a, f) in enumerate(rows)], BATCH)


def upsert(store, rows, **kw):
    new = batch(store.spark, rows)
    return store.commit(state.upsert(store.around(new), new, now=NOW()).chain, now=NOW(), **kw)


def prices(store, months=None):
    return {str(r.observed_on): (str(r.average), r.revision_no) for r in store.observations(months).collect()}


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_an_upsert_reads_and_writes_the_months_it_touches(store, tmp_path):
    upsert(store, [("2026-05-03", "5", "a"), ("2026-06-03", "6", "a"), ("2026-07-01", "7", "a"), ("2026-07-02", "8", "a")])
    before = files(tmp_path)
    new = batch(store.spark, [("2026-07-02", "9", "b")])
    around = store.around(new)
    read = around.inputFiles()
    assert read and all("month=2026-07" in f for f in read) and around.count() == 2
    upsert(store, [("2026-07-02", "9", "b")])
    assert {k: v for k, v in files(tmp_path).items() if k in before} == before
    made = {f.split("/month=")[1][:7] for f in files(tmp_path).keys() - before.keys() if "/month=" in f}
    assert made == {"2026-07"}
    head = store.head()
    assert head.months == {"2026-05": 1, "2026-06": 1, "2026-07": 2}
    assert prices(store) == {"2026-05-03": ("5.00", 0), "2026-06-03": ("6.00", 0), "2026-07-01": ("7.00", 0), "2026-07-02": ("9.00", 1)}
    assert prices(store, ["2026-05"]) == {"2026-05-03": ("5.00", 0)}
    (old,) = store.revisions().collect()
    assert (str(old.average), old.revision_no, old.c, old.source_file_sha256) == ("8.00", 0, 2, "a") and old.superseded_at == dt.datetime(2026, 8, 1)


def test_revisions_are_one_scan(store):
    for k in range(4):
        upsert(store, [("2026-07-02", str(k), f"f{k}")])
    rows = store.revisions()
    assert [r.revision_no for r in rows.orderBy("revision_no").collect()] == [0, 1, 2]
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_an_empty_batch_and_a_repeated_one(store):
    upsert(store, [])
    assert store.head().number == 1 and prices(store) == {} and store.revisions().count() == 0
    upsert(store, [("2026-07-02", "1", "a")], writer="w", batch=5)
    assert upsert(store, [("2026-07-02", "2", "b")], writer="w", batch=5).number == 2
    assert upsert(store, [("2026-07-02", "2", "b")], writer="w", batch=4).number == 2 and prices(store) == {"2026-07-02": ("1.00", 0)}
    assert upsert(store, [("2026-07-02", "2", "b")], writer="v", batch=5).number == 3


def test_two_writers_of_one_number(store):
    upsert(store, [("2026-07-02", "1", "a")])
    with pytest.raises(RuntimeError):
        store._publish(stores.Commit(1))


def test_vacuum_removes_what_no_record_names(store):
    upsert(store, [("2026-06-02", "1", "a"), ("2026-07-02", "1", "a")])
    upsert(store, [("2026-07-02", "2", "b")])
    batch(store.spark, [("2026-07-02", "3", "x")]).write.parquet(f"{store.path}/quarantine/c=00000009")
    before, revisions = prices(store), store.revisions().collect()
    gone = store.vacuum()
    assert sorted(gone) == ["prices/c=00000001/is_current=true/month=2026-07", "quarantine/c=00000009"]
    assert prices(store) == before and store.revisions().collect() == revisions and store.vacuum() == []


def sheets(spark):
    return lambda: (sheet_queries._cells(spark, SF), sheet_queries._headers(spark, SF))


def ingest(store, run_id="run", read=None):
    today = F.lit(sheet_queries.TODAY)
    return run_ingest(store, Run(run_id, "sheets"), read or sheets(store.spark), sheet_queries._dims(store.spark, SF), today, NOW())


def seen(store):
    """All that readers see, but for when."""
    state_ = sorted((str(r) for r in store.observations().drop("ingested_at").collect()))
    return state_, store.revisions().count(), sorted(r.id for r in store.quarantine().collect()), sorted(r.id for r in store.markets().collect())


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
def test_a_crash_between_any_two_writes_shows_nothing_or_all(store, monkeypatch):
    write, publish = Store._write, Store._publish
    whole, left = None, 0
    for k in range(1, 20):
        calls = iter(range(1, 100))

        def failing(f):
            def run(*args):
                if next(calls) == k + 2:  # the first write and record are the opened row
                    raise OSError("gone")
                return f(*args)

            return run

        monkeypatch.setattr(Store, "_write", failing(write))
        monkeypatch.setattr(Store, "_publish", failing(publish))
        try:
            ingest(store)
        except OSError:
            assert seen(store) == ([], 0, [], [])
            (run,) = store.runs().collect()
            assert (run.status, run.finished_at) == ("running", None)
            left += 1
            continue
        whole = seen(store)
        break
    # prices, quarantine, markets, the closed row, the record
    assert left == 5 and whole and whole[0] and whole[2] and whole[3]
    (run,) = store.runs().collect()
    assert run.status == "partial" and run.rows_quarantined == len(whole[2]) and run.finished_at is not None
    # A run that is repeated changes nothing, and has one row.
    monkeypatch.undo()
    ingest(store)
    assert seen(store) == whole and [(r.run_id, r.status, r.rows_upserted, r.rows_quarantined) for r in store.runs().collect()] == [("run", "partial", 0, 0)]


def test_a_refused_source_is_a_failed_run(store):
    def read():
        raise SourceRefused("robots.txt forbids this source")

    ingest(store, "r1", read)
    (run,) = store.runs().collect()
    assert (run.run_id, run.status, run.error, run.files_seen) == ("r1", "failed", "robots.txt forbids this source", 0) and seen(store) == ([], 0, [], [])
    with pytest.raises(ValueError):
        Run("r", "s").row(store.spark, "done", NOW())


def test_equal_quarantine_rows_of_a_run_are_one(spark, store):
    from marketloom.operators import ledger

    rows = spark.createDataFrame([(1, "bad"), (1, "bad"), (2, "bad"), (3, None)], "row_no int, why string").withColumn("file_sha", F.lit("f"))
    held = ledger.held(rows, "parse", F.col("why"), ["row_no"], "s", "r")
    own = Run("r", "s")
    for _ in range(2):
        store.commit(tables={"quarantine": store.fresh_quarantine(held, "r"), "runs": own.row(spark, "succeeded", NOW(), NOW())})
    assert store.quarantine().count() == 2
    other = ledger.held(rows, "parse", F.col("why"), ["row_no"], "s", "q")
    store.commit(tables={"quarantine": store.fresh_quarantine(other, "q"), "runs": Run("q", "s").row(spark, "succeeded", NOW(), NOW())})
    assert store.quarantine().count() == 4 and store.runs().count() == 2
