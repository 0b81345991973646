"""The registered queries of this package and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .common import prepared

#: query name -> module with ``query(spark, sf_dir)`` and, where SQL can say the same, ``SQL``.
MODULES = {
    "op1_quality_rules": "quality",
    "op1_quality_ablations": "ablations",
    "op2_mix_sources": "mixing",
    "op2_mix_copies": "mixcopies",
    "op3_exact_dedup": "exact",
    "op4_language_id": "langid",
    "op5_byte_bpe": "bpe",
    "op6_token_counts": "counts",
    "op7_id_files": "idfile",
    "op8_secret_scan": "secrets",
    "op9_near_duplicates": "neardup",
    "op10_suffix_dedup": "repeats",
    "op11_simhash_duplicates": "simhash",
    "op12_prefix_trie": "trie",
    "op13_periodic_runs": "runs",
}


def _module(name: str):
    return import_module(f"{__package__}.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(module):
        return lambda spark, sf_dir: module.query(prepared(spark), sf_dir)

    return {name: bound(_module(m)) for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, m in MODULES.items() if (sql := getattr(_module(m), "SQL", None))}
