"""One ingest, from cells and headers to observations, revisions and quarantine, as a single plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FIGURES
from ..sources import sheets
from ..storage import stored as stored_table
from . import ledger, resolve, state


@dataclass(frozen=True)
class Ingest:
    upsert: state.Upsert
    quarantine: DataFrame
    markets: DataFrame
    files: DataFrame


def placed_files(cells: DataFrame, headers: DataFrame, regions: DataFrame, today: Column) -> DataFrame:
    """headers with psgc_code, stage and reason: why a file is refused whole, or null.

    A header that cannot be read comes first, then a sheet without column header, then an unknown province, then a date after ``today``.
    """
    shape = sheets.refused_files(cells).select("file_sha", F.col("reject_reason").alias("_shape"))
    out = resolve.resolve_provinces(headers, regions).join(shape, "file_sha", "left")
    parse = F.coalesce("reject_reason", "_shape")
    unknown = F.concat(F.lit("province '"), F.col("province"), F.lit("' is not a seeded region"))
    late = F.concat(F.lit("sheet is dated "), F.col("observed_on").cast("string"), F.lit(", after the run date "), today.cast("string"))
    place = F.when(F.col("psgc_code").isNull(), unknown).when(F.col("observed_on") > today, late)
    return out.withColumns({"stage": F.when(parse.isNotNull(), "parse").when(place.isNotNull(), "validate"), "reason": F.coalesce(parse, place)}).drop("_shape", "reject_reason")


def ingest(
    cells: DataFrame, headers: DataFrame, stored: DataFrame | Callable[[DataFrame], DataFrame], dims: dict[str, DataFrame], source: str, run_id: str,
    today: Column | None = None, now: Column | None = None,
) -> Ingest:
    """cells: as ``sheets`` takes them; headers: one row per file (``sheets.sheet_headers``) with ``file_seq``, the order in which files count.

    stored: the facts so far, or what gives of them those that a batch may touch. dims: commodities, commodity_aliases, regions, markets. Refused files are held whole, rows at parse or alias, and keys that
    one file tells in two ways at validate. Markets not known yet are made; two spellings of a market are one. Parsed and
    resolved rows are stored once, and all results read from there.
    """
    today = today if today is not None else F.current_date()
    files = stored_table(placed_files(cells, headers, dims["regions"], today), "sheet-files")
    good = files.filter("reason is null")
    fresh = resolve.new_markets(good.withColumnRenamed("psgc_code", "region_psgc_code"), dims["markets"])
    markets = dims["markets"].select("id", "region_psgc_code", "municipality", "name").unionByName(fresh)
    named = resolve.with_market(good.select("file_sha", "file_seq", "observed_on", "psgc_code", "municipality", "market"), markets)
    rows = stored_table(sheets.price_rows(cells).join(named.drop("psgc_code", "municipality", "market"), "file_sha"), "sheet-rows")
    resolved = stored_table(resolve.resolve_commodities(rows.filter("reject_reason is null"), dims["commodity_aliases"], dims["commodities"]), "resolved-rows")
    batch = resolved.filter("alias_reason is null").select(
        F.lit(source).alias("source"), F.col("market_id").alias("market"), F.col("canonical_slug").alias("commodity"), "observed_on",
        *FIGURES, "unavailable", F.col("file_sha").alias("source_file_sha256"), "file_seq", F.col("row_no").alias("position"),
    )
    done = state.upsert_files(stored(batch) if callable(stored) else stored, batch, now=now)
    told = F.format_string("%d rows in one batch resolve to commodity %s at market %d on %s with different figures", "rows_rejected", "commodity", "market", F.col("observed_on").cast("string"))
    disputed = done.conflicts.join(files.select("file_seq", "file_sha"), "file_seq")
    held = ledger.quarantine(
        ledger.held(files, F.col("stage"), F.col("reason"), ["province", "municipality", "market", "observed_on"], source, run_id, now),
        ledger.held(rows, "parse", F.col("reject_reason"), ["row_no", "cells", "group"], source, run_id, now),
        ledger.held(resolved, "alias", F.col("alias_reason"), ["row_no", "group", "commodity", "specification", "unit", "alias_key"], source, run_id, now),
        ledger.held(disputed, "validate", told, ["source", "market", "commodity", "observed_on"], source, run_id, now),
    )
    return Ingest(done, held, fresh, files)


def run_summary(done: Ingest, chain: DataFrame | None = None, quarantine: DataFrame | None = None) -> DataFrame:
    """What the run's row of the ledger says: files seen and failed, rows written and held back, and the status that follows.

    chain, quarantine: the same rows where they have been written, so that they are not made again.
    """
    chain, quarantine = (a if a is not None else b for a, b in ((chain, done.upsert.chain), (quarantine, done.quarantine)))
    zero = F.lit(0).cast("long")
    parts = done.files.agg(F.count("*").alias("files_seen"), F.count_if(F.col("reason").isNotNull()).alias("files_failed"), zero.alias("rows_upserted"), zero.alias("rows_quarantined"))
    parts = parts.union(chain.agg(zero, zero, F.count_if(F.col("kind") != "stored"), zero)).union(quarantine.agg(zero, zero, zero, F.count("*")))
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns]).withColumn("status", F.when(F.col("files_failed") > 0, ledger.status_of(True, 1)).otherwise(ledger.status_of(True, 0)))
