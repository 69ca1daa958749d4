"""Frames the registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.operators.matching import prepare_profiles
from postlens.operators.postings import normalize_postings
from postlens.plans.views import view
from postlens.session import INPUT_PARTS, prepare
from postlens.tables import written

CAPTURE_DAY = "2026-07-30"


def spread(df: DataFrame) -> DataFrame:
    """Deal an input into as many parts as the session asks for in ``INPUT_PARTS``.

    Unset, as on a cluster, the input is read split by split without a shuffle.  A session over
    tables of one row group sets it, since such a table can only be read by one task.
    """
    parts = df.sparkSession.conf.get(INPUT_PARTS, None)
    return df.repartition(int(parts)) if parts else df


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(view(prepare(spark), sf_dir, "v_postings"))


def postings(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    """Typed postings plus ``seq`` (position) and ``seen_at`` (capture time).

    ``stored`` writes the raw rows first: normalising reads its input three times, and where ``part`` is too
    large to be sent around, each reading of the view moves all lines.
    """
    today = F.lit(CAPTURE_DAY).cast("date")
    raw = raw_postings(spark, sf_dir)
    return normalize_postings(written(raw, "raw") if stored else raw, today, keep=("seq", "seen_at"))


# Literal preference lists for the three profiles of the derived view.
PREFERENCES = {
    1: (("Software Engineer", "Backend Engineer", "hot gear Engineer"),
        ("Bangalore", "NATION_3", "Remote"), ("python", "django"), ("Sales", "Unpaid")),
    2: (("Analyst",), (), ("aws", "python"), ("cold",)),
    3: (("red widget Developer", "Lead blue bolt"), ("Germany", "NATION_11"),
        ("django", "kafka"), ("Director",)),
}


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = view(prepare(spark), sf_dir, "v_profiles")
    lists = spark.createDataFrame(
        [(k, list(r), list(p), list(s), list(x)) for k, (r, p, s, x) in PREFERENCES.items()],
        "profile_id int, preferred_roles array<string>, preferred_locations array<string>, "
        "preferred_skills array<string>, excluded_keywords array<string>",
    )
    return base.join(lists, "profile_id").select(
        "profile_id", "seniority", "remote_preference",
        F.col("max_gap").alias("max_seniority_gap"),
        F.col("include_unknown").alias("include_unknown_location"),
        F.col("threshold").cast("double").alias("match_threshold"),
        "preferred_roles", "preferred_locations", "preferred_skills", "excluded_keywords",
    )


__all__ = ["CAPTURE_DAY", "PREFERENCES", "postings", "prepare_profiles", "profiles",
           "raw_postings", "spread"]
