"""The price table kept from a stream: each micro-batch is one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..operators.store import Store, quarantine_id
from ..storage import passing, stored


def daily_prices(events: DataFrame, lateness: str = "14 days") -> DataFrame:
    """Low, high and average per event type, user and day, in exact cents; later arrivals than ``lateness`` are dropped by the watermark."""
    cents = F.round(F.col("value") * 100).cast("long")
    day = F.window("ts", "1 day")
    grouped = events.withWatermark("ts", lateness).groupBy(day, F.col("event_type").alias("commodity"), F.col("user_id").alias("market"))
    out = grouped.agg(F.min(cents).alias("low_cents"), F.max(cents).alias("high_cents"), F.sum(cents).alias("s"), F.count("*").alias("c"))
    return out.select("commodity", "market", F.to_date(F.col("window.start")).alias("observed_on"), "low_cents", "high_cents", F.expr("(2 * s + c) div (2 * c)").alias("average_cents"))


def first_sightings(urls: DataFrame, lateness: str = "1 day") -> DataFrame:
    """A stream of (url, ts) with each URL once within the watermark: the fetch-once rule for streams."""
    return urls.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["url"])


class Upserter:
    """foreachBatch sink into a store: a batch is one commit, which reads and writes the months that it touches.

    Nothing is kept in memory. After a restart the state is read from the store; a batch that runs again finds that it has been committed and does
    nothing. ``held`` makes quarantine rows of a batch; they and the facts are to be seen together or not at all.
    """

    def __init__(self, path: str, writer: str = "stream", held: Callable[[DataFrame], DataFrame] | None = None):
        self.path, self.writer, self.held = path, writer, held

    def current(self, spark: SparkSession) -> DataFrame:
        return Store(spark, self.path).observations()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, self.path)
        if store.head().writers.get(self.writer, -1) >= batch_id:
            return
        with passing(batch.sparkSession):
            batch = stored(batch, "micro-batch")  # read for its months, its kinds and its late repeats
            tables = {"quarantine": quarantine_id(self.held(batch))} if self.held else None
            store.commit(state.upsert(store.around(batch), batch).chain, tables, writer=self.writer, batch=batch_id)
