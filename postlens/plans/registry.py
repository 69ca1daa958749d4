"""All registered queries with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.operators.candidates import matches as matching_pairs
from postlens.operators.matching import results_query
from postlens.plans.sources import postings, profiles
from postlens.operators.postings import within_batch_dedup
from postlens.tables import written

AREAS = (
    "text_checks", "posting_checks", "matching_checks", "telemetry_checks", "page_checks", "board_checks",
    "stream_checks",
)


def _areas():
    return [import_module(f"postlens.plans.{name}") for name in AREAS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for area in _areas() for name, fn in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in _areas() for name, sql in area.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = within_batch_dedup(
        postings(spark, sf_dir), [F.col(c) for c in ("seq", "url", "location_raw", "seen_at")]
    ).withColumns({"first_seen_at": F.col("seen_at"), "is_active": F.lit(True)})
    keys = ["company_id", "content_hash"]
    rows = written(rows, "postings")
    matches = matching_pairs(rows, profiles(spark, sf_dir)).select(
        *keys, "profile_id", "score", "reasoning"
    )
    return results_query(
        rows, matches, keys, profile_id=1, limit=20, order=[F.col("seq")]
    ).select("company_id", "content_hash", "title", "location_raw", "seniority", "score", "reasoning")
