import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.operators import ledger, state
from marketloom.operators.store import Store
from marketloom.streaming import reconcile

from .test_state import batch


@pytest.fixture
def store(tmp_path):
    return f"file://{tmp_path}/prices"


def prices(rows):
    return {r.observed_on.day: (str(r.average), r.revision_no) for r in rows.collect()}


def test_state_survives_a_restart(spark, store):
    reconcile.Upserter(store)(batch(spark, [(1, "10.00", "a"), (2, "20.00", "a")]), 0)
    again = reconcile.Upserter(store)
    again(batch(spark, [(2, "21.00", "b"), (3, "30.00", "b")]), 1)
    assert prices(again.current(spark)) == {1: ("10.00", 0), 2: ("21.00", 1), 3: ("30.00", 0)}
    assert [(str(r.average), r.revision_no, r.c) for r in Store(spark, store).revisions().collect()] == [("20.00", 0, 2)]


def test_a_batch_that_runs_again_changes_nothing(spark, store):
    one, two = batch(spark, [(1, "10.00", "a")]), batch(spark, [(1, "11.00", "b")])
    sink = reconcile.Upserter(store)
    sink(one, 0)
    sink(two, 1)
    before = sink.current(spark).collect()
    sink(two, 1)
    sink(one, 0)
    assert sink.current(spark).collect() == before and Store(spark, store).head().number == 2
    # A batch that failed while it wrote leaves a folder that no record names.
    state.upsert(Store(spark, store).observations(), two).chain.limit(0).write.parquet(f"{store}/prices/c=00000003")
    assert sink.current(spark).collect() == before
    sink(batch(spark, [(1, "12.00", "c")]), 2)
    assert prices(sink.current(spark)) == {1: ("12.00", 2)}


def test_facts_and_what_is_held_back_come_together(spark, store, monkeypatch):
    held = lambda rows: ledger.held(rows.withColumn("file_sha", F.col("source_file_sha256")), "validate", F.when(F.col("average") > 15, "dear"), ["average"], "s", "stream")
    sink = reconcile.Upserter(store, held=held)
    sink(batch(spark, [(1, "10.00", "a"), (2, "20.00", "a")]), 0)
    publish = Store._publish
    monkeypatch.setattr(Store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        sink(batch(spark, [(1, "30.00", "b")]), 1)
    assert prices(sink.current(spark)) == {1: ("10.00", 0), 2: ("20.00", 0)} and Store(spark, store).quarantine().count() == 1
    monkeypatch.setattr(Store, "_publish", publish)
    sink(batch(spark, [(1, "30.00", "b")]), 1)
    assert prices(sink.current(spark)) == {1: ("30.00", 1), 2: ("20.00", 0)} and Store(spark, store).quarantine().count() == 2


def events(spark, path, rows):
    df = spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double, url string")
    df.coalesce(1).write.mode("append").parquet(path)


def test_streams_from_files(spark, tmp_path, store):
    src, day = f"{tmp_path}/events", lambda d: dt.datetime(2024, 1, d, 12)
    events(spark, src, [(day(1), 1, "click", 1.0, "a"), (day(1), 1, "click", 2.01, "b"), (day(2), 2, "view", 4.0, "a")])
    schema = spark.read.parquet(src).schema

    def run(name, build, sink):
        stream = build(spark.readStream.schema(schema).parquet(src))
        writer = stream.writeStream.option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True)
        sink(writer).start().awaitTermination(120)

    run("daily", lambda s: reconcile.daily_prices(s, "1 day"), lambda w: w.outputMode("complete").format("memory").queryName("daily"))
    got = {(r.commodity, r.market, str(r.observed_on)): (r.low_cents, r.high_cents, r.average_cents) for r in spark.table("daily").collect()}
    assert got == {("click", 1, "2024-01-01"): (100, 201, 151), ("view", 2, "2024-01-02"): (400, 400, 400)}
    run("seen", lambda s: reconcile.first_sightings(s.select("url", "ts")), lambda w: w.format("memory").queryName("seen"))
    assert sorted(r.url for r in spark.table("seen").collect()) == ["a", "b"]

    def facts(s):
        cents = F.round(F.col("value") * 100).cast("decimal(14,0)") / F.lit(100).cast("decimal(3,0)")
        money = [cents.cast("decimal(12,2)").alias(c) for c in ("low", "high", "prevailing", "average")]
        return s.select(F.lit("s").alias("source"), F.col("user_id").alias("market"), F.col("event_type").alias("commodity"), F.to_date("ts").alias("observed_on"), *money, F.lit(False).alias("unavailable"), F.col("url").alias("source_file_sha256"), F.col("url").alias("position"))

    def once():
        run("facts", lambda s: facts(s.filter("event_type = 'view'")), lambda w: w.foreachBatch(reconcile.Upserter(store)))
        return [(r.market, str(r.average), r.revision_no) for r in Store(spark, store).observations().collect()]

    assert once() == [(2, "4.00", 0)]
    events(spark, src, [(day(2), 2, "view", 5.0, "c")])
    # A new sink on the same store goes on from what is there.
    assert once() == [(2, "5.00", 1)] and once() == [(2, "5.00", 1)]
