"""The revisioned fact table: collapse of a batch, replay of a history, incremental upsert.

Parquet has no MERGE, so an upsert computes a chain of versions of every key: the last one is the state, the ones before it are
archived. ``store`` keeps chains by month.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FIGURES, NATURAL_KEY

FIGURE_COLUMNS = (*FIGURES, "unavailable")


def figures(prefix: str = "") -> Column:
    """What makes two sightings of a price the same; where it came from does not."""
    return F.struct(*[F.col(f"{prefix}{c}") for c in FIGURE_COLUMNS])


def quantised(df: DataFrame) -> DataFrame:
    """Prices to two places, half up, before anything is compared."""
    return df.withColumns({c: F.col(c).cast("decimal(12,2)") for c in FIGURES})


def invalid_reason() -> Column:
    return F.when(F.col("low") > F.col("high"), F.concat(F.lit("low "), F.col("low").cast("string"), F.lit(" is above high "), F.col("high").cast("string"))).when(
        F.col("unavailable") & F.coalesce(*[F.col(c) for c in FIGURES]).isNotNull(), F.lit("unavailable with prices")
    )


def valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be stored, the others with ``invalid_reason``)."""
    judged = df.withColumn("invalid_reason", invalid_reason())
    return judged.filter("invalid_reason is null").drop("invalid_reason"), judged.filter("invalid_reason is not null")


@dataclass(frozen=True)
class Collapsed:
    settled: DataFrame
    conflicts: DataFrame
    counts: DataFrame


def collapse_duplicates(batch: DataFrame, order: str = "position", key: tuple[str, ...] = NATURAL_KEY) -> Collapsed:
    """Equal repeats of a key are one row, its first; a key with differing rows is in conflict and leaves no row.

    conflicts: the key, how many rows it is about (the first, and all from the first disagreement on). counts: one row with the
    number of rows, of those of disputed keys, and of disputed keys. ``order`` is unique within a key.
    """
    # A key is one row of each task before anything moves, however many rows it has. Settled rows and counts read the same columns
    # of ``keys``, so that a plan with both has one exchange for them; the rest of a row is an aggregate of its own, which goes where nobody reads it.
    rest = [c for c in batch.columns if c not in (*key, *FIGURE_COLUMNS, order)]
    first = F.min(F.struct(F.col(order).alias("at"), figures().alias("figures"))).alias("_first")
    whole = [F.min_by(F.struct(*rest), order).alias("_rest")] if rest else []
    keys = batch.groupBy(*key).agg(first, F.min(figures()).alias("_low"), F.max(figures()).alias("_high"), F.count("*").alias("_n"), *whole)
    keys = keys.filter("_n > 0 and _first is not null").withColumn("_disputed", ~F.col("_low").eqNullSafe(F.col("_high")))
    fields = {order: "_first.at"} | {c: f"_first.figures.{c}" for c in FIGURE_COLUMNS} | {c: f"_rest.{c}" for c in rest}
    settled = keys.filter(~F.col("_disputed")).select(*[F.col(fields.get(c, c)).alias(c) for c in batch.columns])
    # All rows from the first disagreement on, which comes after the first row, are looked up among those of disputed keys. A key is one struct,
    # in which nulls are equal. Neither side is broadcast: stored prices make much smaller files than rows.
    whole_key = F.struct(*key).alias("_key")
    again = keys.filter("_disputed").select(whole_key, F.col("_first.figures").alias("_figures"))
    split = F.min(F.when(~figures().eqNullSafe(F.col("_figures")), F.col(order))).over(Window.partitionBy("_key"))
    late = batch.select(whole_key, *FIGURE_COLUMNS, order).hint("shuffle_merge").join(again, "_key").withColumn("_split", split).filter(F.col(order) >= F.col("_split"))
    conflicts = late.groupBy("_key").agg((F.count("*") + 1).alias("rows_rejected")).select("_key.*", "rows_rejected")
    sums = F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_disputed"), F.col("_n"))), F.lit(0)), F.count_if("_disputed")
    counts = keys.agg(*[c.alias(name) for c, name in zip(sums, ("rows", "disputed", "conflicts"))])
    return Collapsed(settled, conflicts, counts)


def revision_chain(history: DataFrame, order: str = "file_seq", key: tuple[str, ...] = NATURAL_KEY) -> DataFrame:
    """All changes of each key, with revision_no from 0 and is_current on the last. history: one settled row per key and file."""
    w = Window.partitionBy(*key).orderBy(order)
    seen = history.withColumns({"_n": F.row_number().over(w), "_before": F.lag(figures()).over(w)})
    changed = seen.filter((F.col("_n") == 1) | ~figures().eqNullSafe(F.col("_before"))).drop("_n", "_before")
    return changed.withColumns({"revision_no": F.row_number().over(w) - 1, "is_current": F.lead(F.lit(1)).over(w).isNull()})


def replay(stored: DataFrame, settled: DataFrame, order: str = "file_seq", now: Column | None = None) -> DataFrame:
    """The chain of every key from its stored row on: the columns of the fact table, at, is_current and kind.

    settled: one row per key and file. A new key starts with revision 0; equal figures change nothing, provenance included;
    different ones follow with the next number. kind is stored, inserted or revised; at is when a row was written.
    """
    now = now if now is not None else F.current_timestamp()
    key, some = list(NATURAL_KEY), [*FIGURE_COLUMNS, "source_file_sha256"]
    old = stored.select(*key, *some, F.col("revision_no").alias("_base"), F.col("ingested_at").alias("at"), F.lit(0).alias("_new"), F.lit(None).cast(settled.schema[order].dataType).alias("_order"))
    new = quantised(settled).select(*key, *some, F.lit(None).cast("int").alias("_base"), now.alias("at"), F.lit(1).alias("_new"), F.col(order).alias("_order"))
    w = Window.partitionBy(*key).orderBy("_new", "_order")
    seen = old.union(new).withColumns({"_n": F.row_number().over(w), "_before": F.lag(figures()).over(w), "_base": F.coalesce(F.first("_base").over(w), F.lit(0))})
    changed = seen.filter((F.col("_n") == 1) | ~figures().eqNullSafe(F.col("_before")))
    number = F.row_number().over(w)
    out = changed.withColumns({"_k": number, "is_current": F.lead(F.lit(1)).over(w).isNull()})
    kind = F.when(F.col("_new") == 0, "stored").when(F.col("_k") == 1, "inserted").otherwise("revised")
    return out.select(*key, *FIGURE_COLUMNS, (F.col("_base") + F.col("_k") - 1).cast("int").alias("revision_no"), "source_file_sha256", "at", "is_current", kind.alias("kind"))


def state_of(chain: DataFrame) -> DataFrame:
    return chain.filter("is_current").select(*NATURAL_KEY, *FIGURE_COLUMNS, "revision_no", "source_file_sha256", F.col("at").alias("ingested_at"))


def revisions_of(chain: DataFrame, now: Column | None = None) -> DataFrame:
    now = now if now is not None else F.current_timestamp()
    return chain.filter("not is_current").select(*NATURAL_KEY, "revision_no", *FIGURE_COLUMNS, "source_file_sha256", now.alias("superseded_at"))


@dataclass(frozen=True)
class Upsert:
    state: DataFrame
    revisions: DataFrame
    outcome: DataFrame
    chain: DataFrame
    conflicts: DataFrame


def upsert(stored: DataFrame, batch: DataFrame, order: str = "position", now: Column | None = None) -> Upsert:
    """New state, revisions to append, and one row of counts, of one batch (a file). Keys in conflict within it leave the stored row alone."""
    return _upserted(stored, batch, order, now, NATURAL_KEY)


def upsert_files(stored: DataFrame, batch: DataFrame, order: str = "position", now: Column | None = None) -> Upsert:
    """As ``upsert``, of many files (column ``file_seq``) one after the other: conflicts are those within a file, later files revise earlier ones."""
    return _upserted(stored, batch, order, now, (*NATURAL_KEY, "file_seq"))


def _upserted(stored: DataFrame, batch: DataFrame, order: str, now: Column | None, key: tuple[str, ...]) -> Upsert:
    cut = collapse_duplicates(quantised(batch), order, key)
    chain = replay(stored, cut.settled, "file_seq" if "file_seq" in key else order, now)
    one = lambda k: F.count_if(F.col("kind") == k)
    zero = F.lit(0).cast("long")
    # One row of each kind of count, summed: every agreeing repeat in the batch counts as unchanged as well.
    parts = cut.counts.select("rows", "disputed", "conflicts", zero.alias("rejected"), zero.alias("inserted"), zero.alias("revised"))
    parts = parts.union(cut.conflicts.agg(zero, zero, zero, F.coalesce(F.sum("rows_rejected"), zero), zero, zero))
    parts = parts.union(chain.agg(zero, zero, zero, zero, one("inserted"), one("revised")))
    sums = parts.agg(*[F.sum(c).alias(c) for c in parts.columns])
    outcome = sums.select("inserted", "revised", F.expr("rows - disputed - inserted - revised").alias("unchanged"), "conflicts", "rejected")
    return Upsert(state_of(chain), revisions_of(chain, now), outcome, chain, cut.conflicts)
