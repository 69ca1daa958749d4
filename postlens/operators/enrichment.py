"""Detail pages merged into stored postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlens.functions.dates import parse_posted_datetime
from postlens.functions.fields import level_in_text, seniority_of, skill_digest, skills_in_key
from postlens.functions.text import blank_to_null, clean_text, normalize_key


def _body(description: Column, requirements: Column) -> Column:
    return F.concat(F.coalesce(requirements, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit("")))


def _read_details(details: DataFrame, keys: list[str]) -> DataFrame:
    """What enrichment needs of the detail texts, read once per detail however many postings share it."""
    texts = details.select(
        *keys, blank_to_null(clean_text(F.col("description"))).alias("__d"),
        blank_to_null(clean_text(F.col("requirements"))).alias("__r"),
        F.col("posted_at").alias("__p"), F.lit(True).alias("__hit"),
    )
    return texts.withColumns({
        "__d_key": skill_digest(normalize_key(F.col("__d"))), "__r_key": skill_digest(normalize_key(F.col("__r"))),
        "__level": level_in_text(_body(F.col("__d"), F.col("__r"))),
    })


def enrich_update(postings: DataFrame, details: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Fill texts from ``details(*keys, description, requirements, posted_at)``.

    ``keys`` tell a detail; several postings may share one.  Skills are read again; seniority only where
    the listing left it unknown; the timestamp only where it is missing.  Adds ``was_seniority``,
    ``fetched`` and ``enriched``.
    """
    joined = postings.join(_read_details(details, keys), keys, "left")
    useful = F.col("__d").isNotNull() | F.col("__r").isNotNull()
    silent = F.col("enriched") & (F.coalesce("seniority", F.lit("unknown")) == "unknown")
    # the level of the detail holds where the posting adds no text of its own
    alone = [F.col(new).isNotNull() | (F.coalesce(own, F.lit("")) == "")
             for new, own in (("__d", "description"), ("__r", "requirements"))]
    filled = joined.withColumns({
        "was_seniority": F.col("seniority"),
        "fetched": F.col("__hit").isNotNull(),
        "enriched": useful,
        "__alone": alone[0] & alone[1],
        "description": F.when(useful, F.coalesce("__d", "description")).otherwise(F.col("description")),
        "requirements": F.when(useful, F.coalesce("__r", "requirements")).otherwise(F.col("requirements")),
    })
    title, description, requirements = (F.col(c) for c in ("title", "description", "requirements"))
    words = [
        normalize_key(title),
        F.when(F.col("__d").isNotNull(), F.col("__d_key")).otherwise(normalize_key(description)),
        F.when(F.col("__r").isNotNull(), F.col("__r_key")).otherwise(normalize_key(requirements)),
    ]
    level = F.when(F.col("__alone"), F.col("__level")).otherwise(level_in_text(_body(description, requirements)))
    return filled.withColumns({
        "detected_skills": F.when(
            F.col("enriched"), skills_in_key(F.concat_ws(" ", *map(blank_to_null, words)))
        ).otherwise(F.col("detected_skills")),
        "seniority": F.when(silent, seniority_of(title, level)).otherwise(F.col("seniority")),
        "posted_at": F.coalesce(
            "posted_at", F.when(F.col("enriched"), parse_posted_datetime(F.col("__p"), now))
        ),
    }).drop("__d", "__r", "__p", "__hit", "__d_key", "__r_key", "__level", "__alone")


def enrichment_report(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count(F.lit(1)).alias("considered"), F.count_if("fetched").alias("fetched"),
        F.count_if("enriched").alias("enriched"),
        F.count_if(F.col("seniority") != F.col("was_seniority")).alias("reclassified"),
    )
