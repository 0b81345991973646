"""Tables of the price platform, and the fixed values that its rules name."""

from __future__ import annotations

from dataclasses import dataclass

MONEY = "decimal(12,2)"
FIGURES = ("low", "high", "prevailing", "average")
NATURAL_KEY = ("source", "market", "commodity", "observed_on")

TABLES = {
    "sources": "slug string, name string, base_url string, robots_checked_at timestamp, robots_allowed boolean, licence string, attribution_text string",
    "regions": "psgc_code string, name string, level string",
    "markets": "id long, region_psgc_code string, name string, municipality string",
    "commodities": "id long, canonical_slug string, group string, name string, specification string, unit string",
    "commodity_aliases": "alias_key string, canonical_slug string",
    "price_observations": f"source string, market long, commodity string, observed_on date, low {MONEY}, high {MONEY}, prevailing {MONEY}, average {MONEY}, "
    "unavailable boolean, revision_no int, source_file_sha256 string, ingested_at timestamp",
    "observation_revisions": f"source string, market long, commodity string, observed_on date, revision_no int, low {MONEY}, high {MONEY}, prevailing {MONEY}, "
    f"average {MONEY}, unavailable boolean, source_file_sha256 string, superseded_at timestamp",
    "ingestion_runs": "run_id string, source string, status string, started_at timestamp, finished_at timestamp, files_seen int, files_fetched int, "
    "rows_upserted int, rows_quarantined int, error string",
    "quarantine": "source string, run_id string, stage string, reason string, source_file_sha256 string, source_url string, payload string, created_at timestamp",
    "manifest": "url string, sha256 string, size long, fetched_at timestamp, content_type string, http_status int",
    "cells": "file_sha string, row_no int, page int, cells array<string>",
}

# They must equal the published vocabulary.
INPUT_GROUPS = ("LIVESTOCK & POULTRY FEEDS", "FERTILIZER", "INSECTICIDE", "HERBICIDE", "FUNGICIDE", "MOLLUSCIDE", "RODENTICIDE")
LEVELS = ("region", "province", "municipality", "city")
STATUSES = ("running", "succeeded", "failed", "partial")
STAGES = ("index", "parse", "alias", "validate")
COLUMN_HEADER = ("commodity group", "commodities", "specifications", "unit", "low", "high", "prevailing", "average")
UNITS = {
    "kg": "kg", "kilo": "kg", "kilogram": "kg", "g": "g", "gram": "g", "grams": "g", "l": "L", "liter": "L", "litre": "L", "liters": "L",
    "ml": "mL", "pc": "pc", "pcs": "pc", "piece": "pc", "pieces": "pc", "box": "box", "bag": "bag", "sack": "sack", "tray": "tray", "bundle": "bundle",
}
HEADER_LABELS = {"province": "Province", "municipality": "Municipality/City", "market": "Market Monitored", "observed_on": "Date of Monitoring"}


@dataclass(frozen=True)
class PageRequest:
    """Bounds of a page: 1 to 500 rows, from a position that is not negative."""

    limit: int = 50
    offset: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 500:
            raise ValueError(f"limit must be 1 to 500, got {self.limit}")
        if self.offset < 0:
            raise ValueError(f"offset must not be negative, got {self.offset}")


@dataclass(frozen=True)
class RobustConfig:
    """Settings of the robust outlier rule."""

    window: int = 9
    threshold: float = 3.5
    min_neighbours: int = 4
    min_relative_deviation: float = 0.10

    def __post_init__(self) -> None:
        for name, least in (("window", 3), ("min_neighbours", 2), ("min_relative_deviation", 0)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}, got {getattr(self, name)}")
        if self.threshold <= 0:
            raise ValueError(f"threshold must be positive, got {self.threshold}")

    @classmethod
    def requested(cls, window: int = 9, threshold: float = 3.5) -> RobustConfig:
        """Settings as a request may give them: a window of 3 to 61 observations, a threshold above 0 and up to 50."""
        if not 3 <= window <= 61:
            raise ValueError(f"window must be 3 to 61, got {window}")
        if not 0 < threshold <= 50:
            raise ValueError(f"threshold must be above 0 and at most 50, got {threshold}")
        return cls(window=window, threshold=threshold)
