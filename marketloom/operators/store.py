"""The price platform's tables at rest: facts by month, revisions, quarantine, markets and the run ledger, in one commit.

A commit writes its rows to folders of its own number and then publishes one record, by a rename. Readers follow published records
only, so a writer that dies between any two writes has shown nothing, and the next one takes the same number and replaces what is left. The last
record says, for each month, which commit wrote it; a commit reads and rewrites the months that its batch touches, and no other. What readers may
still be reading is never changed in place; ``vacuum`` removes what no record names any more. One writer at a time: a second one
that publishes the same number is refused.

    prices/c=00000007/is_current=true/month=2026-07/    the state of a month as commit 7 left it
    prices/c=00000007/is_current=false/month=2026-07/   rows that commit 7 archived
    quarantine/c=00000007/, markets/c=00000007/, runs/c=00000007/
    commits/00000007.json

Cases: an empty batch publishes a commit that points to the months as they were; a batch that was committed before (same writer and
number, or the same run) adds nothing twice; a null date has a month of its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import NATURAL_KEY, STATUSES, TABLES
from ..storage import passing
from . import state

CHAIN = TABLES["price_observations"].replace("ingested_at", "at") + ", kind string, superseded_at timestamp"
APPENDED = {
    "quarantine": "id string, " + TABLES["quarantine"],
    "markets": TABLES["markets"],
    "runs": TABLES["ingestion_runs"],
}
NO_MONTH = "none"


@dataclass(frozen=True)
class Commit:
    """number; months: which commit wrote the state of each; writers: the last batch of each; archived, appended: commits with rows in these tables."""

    number: int = 0
    months: dict[str, int] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)
    archived: list[int] = field(default_factory=list)
    appended: dict[str, list[int]] = field(default_factory=dict)


def month_of(date: str = "observed_on") -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(NO_MONTH))


def quarantine_id(rows: DataFrame) -> DataFrame:
    """Rows with an id made of the run and all that they say, but for when; equal ones are one row."""
    said = [c for c in TABLES["quarantine"].replace(" string", "").replace(" timestamp", "").split(", ") if c != "created_at"]
    return rows.withColumn("id", F.sha2(F.to_json(F.struct(*said), {"ignoreNullFields": "false"}), 256)).dropDuplicates(["id"])


class Store:
    """The tables under a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _folder(self, table: str, number: int) -> str:
        return f"{table}/c={number:08d}"

    # -- commits

    def head(self) -> Commit:
        """The last commit; number 0 before the first one."""
        numbers = [n for n in self._names("commits") if n.endswith(".json") and not n.startswith((".", "_"))]
        if not numbers:
            return Commit()
        stream = self._fs.open(self._at(f"commits/{numbers[-1]}"))
        try:
            return Commit(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def _publish(self, commit: Commit) -> None:
        last, new = self._at(f"commits/{commit.number:08d}.json"), self._at(f"commits/_{commit.number:08d}.new")
        self._fs.mkdirs(self._at("commits"))
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(commit.__dict__).encode()))
        stream.close()
        if self._fs.exists(last) or not self._fs.rename(new, last):
            raise RuntimeError(f"commit {commit.number} has been published by another writer")

    def _write(self, rows: DataFrame, folder: str, by: tuple[str, ...] = ()) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{folder}")

    # -- readers

    def _prices(self, paths: list[str], schema: str = CHAIN) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/prices").parquet(*[f"{self.path}/{p}" for p in paths])

    def observations(self, months: list[str] | None = None, head: Commit | None = None) -> DataFrame:
        """The state of all months, or of some: only their files are read."""
        head = head or self.head()
        paths = [f"{self._folder('prices', n)}/is_current=true/month={m}" for m, n in sorted(head.months.items()) if months is None or m in months]
        rows = self._prices(paths)
        return rows.select(*NATURAL_KEY, *state.FIGURE_COLUMNS, "revision_no", "source_file_sha256", F.col("at").alias("ingested_at"))

    def around(self, batch: DataFrame, head: Commit | None = None) -> DataFrame:
        """The state of the months that a batch touches."""
        months = [r.m for r in batch.select(month_of().alias("m")).distinct().collect()]  # as many as the batch has months
        return self.observations(months, head)

    def revisions(self) -> DataFrame:
        """Archived rows, with when they were superseded and by which commit (c), in one scan."""
        rows = self._prices([f"{self._folder('prices', n)}/is_current=false" for n in self.head().archived], CHAIN + ", c int")
        return rows.select(*NATURAL_KEY, "revision_no", *state.FIGURE_COLUMNS, "source_file_sha256", "superseded_at", "c")

    def appended(self, table: str, numbers: list[int] | None = None) -> DataFrame:
        """Rows of quarantine, markets or runs, with their commit (c)."""
        own = [n for n in self.head().appended.get(table, []) if numbers is None or n in numbers]
        schema = f"{APPENDED[table]}, c int"
        if not own:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{self._folder(table, n)}" for n in own])

    def quarantine(self) -> DataFrame:
        return self.appended("quarantine").drop("c")

    def markets(self) -> DataFrame:
        """Markets in the spelling of the commit that made them."""
        rows = self.appended("markets")
        return rows.groupBy("id").agg(F.min_by(F.struct("region_psgc_code", "name", "municipality"), "c").alias("m")).select("id", "m.*")

    def runs(self) -> DataFrame:
        """One row a run: its latest."""
        rows = self.appended("runs")
        return rows.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("c", "run_id")]), "c").alias("r")).select("run_id", "r.*")

    # -- the writer

    def commit(
        self, chain: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, closing: Callable[[Commit], DataFrame] | None = None,
        writer: str | None = None, batch: int | None = None, now: Column | None = None,
    ) -> Commit:
        """Write a chain (``state.replay`` over what ``around`` gives) and rows to append, then publish.

        closing: makes rows of the ledger from what this commit has written so far. writer, batch: a batch that its writer has
        committed before, or an earlier one, is left alone.
        """
        head = self.head()
        if writer is not None and head.writers.get(writer, -1) >= batch:
            return head
        number = head.number + 1
        months, archived, appended = dict(head.months), list(head.archived), {t: list(n) for t, n in head.appended.items()}
        if chain is not None:
            folder = self._folder("prices", number)
            rows = chain.withColumns({"month": month_of(), "superseded_at": F.when(~F.col("is_current"), now if now is not None else F.current_timestamp())})
            self._write(rows.hint("rebalance", "is_current", "month"), folder, ("is_current", "month"))
            months |= {n.removeprefix("month="): number for n in self._names(f"{folder}/is_current=true") if n.startswith("month=")}
            archived += [number] * any(n.startswith("month=") for n in self._names(f"{folder}/is_current=false"))
        new = Commit(number, months, head.writers | ({writer: batch} if writer is not None else {}), archived, appended)
        for table, rows in (tables or {}).items():
            self._append(new, table, rows)
        if closing is not None:
            self._append(new, "runs", closing(new))
        self._publish(new)
        return new

    def _append(self, new: Commit, table: str, rows: DataFrame) -> None:
        names = [c.split(" ")[0] for c in APPENDED[table].split(", ")]
        self._write(rows.select(*names), self._folder(table, new.number))
        new.appended.setdefault(table, []).append(new.number)

    def written(self, new: Commit, table: str) -> DataFrame:
        """What a commit that is not published yet has written."""
        if table == "prices":
            return self.spark.read.schema(CHAIN + ", is_current boolean, month string").option("basePath", f"{self.path}/{self._folder('prices', new.number)}").parquet(f"{self.path}/{self._folder('prices', new.number)}")
        return self.spark.read.schema(APPENDED[table]).parquet(f"{self.path}/{self._folder(table, new.number)}")

    def fresh_quarantine(self, rows: DataFrame, run_id: str) -> DataFrame:
        """Quarantine rows that earlier commits of the same run do not have."""
        own = [r.c for r in self.appended("runs").filter(F.col("run_id") == run_id).select("c").distinct().collect()]  # as many as the run has commits
        rows = quarantine_id(rows)
        return rows.join(self.appended("quarantine", own).select("id"), "id", "left_anti")

    def vacuum(self) -> list[str]:
        """Remove folders that no record names: months written anew since, and what dead writers left. Not while a reader of an earlier commit is at work."""
        head, gone = self.head(), []
        for folder in self._names("prices"):
            n = int(folder.removeprefix("c="))
            for current in self._names(f"prices/{folder}"):
                for month in self._names(f"prices/{folder}/{current}"):
                    named = head.months.get(month.removeprefix("month=")) == n if current == "is_current=true" else n in head.archived
                    if month.startswith("month=") and not named:
                        gone.append(f"prices/{folder}/{current}/{month}")
        for table in APPENDED:
            gone += [f"{table}/{f}" for f in self._names(table) if int(f.removeprefix("c=")) not in head.appended.get(table, [])]
        for at in gone:
            self._fs.delete(self._at(at), True)
        return gone


class SourceRefused(Exception):
    """The source forbids or fails to give its index: the run ends as failed."""


@dataclass(frozen=True)
class Run:
    """What names a run in the ledger."""

    run_id: str
    source: str

    def row(self, spark: SparkSession, status: str, started_at: Column, finished_at: Column | None = None, error: str | None = None, counts: DataFrame | None = None) -> DataFrame:
        if status not in STATUSES:
            raise ValueError(f"no status {status}")
        zero = {c: F.lit(0).cast("int") for c in ("files_seen", "files_fetched", "rows_upserted", "rows_quarantined")}
        base = counts if counts is not None else spark.range(1).select(*[v.alias(k) for k, v in zero.items()])
        return base.select(
            F.lit(self.run_id).alias("run_id"), F.lit(self.source).alias("source"), (F.col("status") if counts is not None else F.lit(status)).alias("status"), started_at.cast("timestamp").alias("started_at"),
            (F.lit(None) if finished_at is None else finished_at).cast("timestamp").alias("finished_at"), *[F.col(c).cast("int").alias(c) for c in zero], F.lit(error).cast("string").alias("error"),
        )


def run_ingest(store: Store, run: Run, read: Callable[[], tuple[DataFrame, DataFrame]], dims: dict[str, DataFrame], today: Column | None = None, now: Column | None = None) -> Commit:
    """One run: its row is opened, sheets are read and ingested, and facts, revisions, quarantine, new markets and the closed row come with one commit.

    read: gives (cells, headers) as ``ingest.ingest`` takes them. Where it raises SourceRefused, the row is closed as failed; on
    any other error the row stays open, and nothing else of the run is to be seen. A run that is repeated finds its facts unchanged, adds the
    quarantine rows that it has not added yet, and its last row counts.
    """
    from . import ingest  # it takes tables from here on its callers' behalf only

    spark, started = store.spark, now if now is not None else F.current_timestamp()
    store.commit(tables={"runs": run.row(spark, "running", started)})
    try:
        cells, headers = read()
    except SourceRefused as e:
        return store.commit(tables={"runs": run.row(spark, "failed", started, started, str(e))})
    known = dims["markets"].select("id", "region_psgc_code", "name", "municipality")
    dims = dims | {"markets": known.unionByName(store.markets().join(known.select("id"), "id", "left_anti"))}
    with passing(spark):  # parsed and resolved rows, which the commit has read when it is published
        done = ingest.ingest(cells, headers, store.around, dims, run.source, run.run_id, today, now)

        def closing(new: Commit) -> DataFrame:
            summary = ingest.run_summary(done, store.written(new, "prices"), store.written(new, "quarantine"))
            return run.row(spark, "succeeded", started, started, counts=summary.withColumn("files_fetched", F.col("files_seen")))

        return store.commit(done.upsert.chain, {"quarantine": store.fresh_quarantine(done.quarantine, run.run_id), "markets": done.markets}, closing, now=now)
