"""Quarantine rows and the run ledger: nothing is dropped silently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import STAGES


def held(rows: DataFrame, stage: str | Column, reason: Column, payload: list[str], source: str | None, run_id: str | None, now: Column | None = None) -> DataFrame:
    """Quarantine rows of one stage (or of the stage that a column names): those of ``rows`` that have a reason, with their columns as JSON."""
    if isinstance(stage, str):
        if stage not in STAGES:
            raise ValueError(f"no stage {stage}")
        stage = F.lit(stage)
    pick = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    return rows.withColumn("_reason", reason).filter("_reason is not null").select(
        F.lit(source).cast("string").alias("source"), F.lit(run_id).cast("string").alias("run_id"), stage.alias("stage"), F.col("_reason").alias("reason"),
        pick("file_sha").cast("string").alias("source_file_sha256"), pick("target").cast("string").alias("source_url"),
        F.to_json(F.struct(*payload)).alias("payload"), (now if now is not None else F.current_timestamp()).alias("created_at"),
    )


def quarantine(*branches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, branches)


def status_of(discovered: bool, files_failed: int) -> str:
    """failed without an index, partial if any file failed; rows held back do not count against a run."""
    return "failed" if not discovered else "partial" if files_failed else "succeeded"


EXIT_CODES = {"succeeded": 0, "failed": 1, "partial": 2}
