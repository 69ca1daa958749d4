"""Postings: normalisation, lifecycle and listing queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from postlens.functions import fixed_values as V
from postlens.functions.dates import parse_posted_date, parse_posted_datetime
from postlens.functions.fields import (
    detect_skills, parse_employment_type, parse_seniority, skill_dictionary, token_shingles,
)
from postlens.functions.hashing import content_hash
from postlens.functions.location import parse_location
from postlens.functions.salary import parse_salary
from postlens.functions.text import blank_to_null, clean_text, is_blank, normalize_key, truncate
from postlens.functions.urls import canonicalize_url
from postlens.operators.common import Part, first_per_key, per_context, with_parts

RAW_COLUMNS = {
    "company_id": "bigint", "seq": "bigint", "title": "string", "url": "string",
    "external_id": "string", "location": "string", "description": "string",
    "requirements": "string", "department": "string", "employment_type": "string",
    "salary": "string", "posted_at": "string", "remote": "string", "tier": "string",
}
KEY = ("company_id", "content_hash")


def as_raw(df: DataFrame) -> DataFrame:
    """Add absent raw columns as nulls; other columns pass through."""
    missing = {
        name: F.lit(None).cast(kind) for name, kind in RAW_COLUMNS.items() if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def normalize_postings(
    raw: DataFrame,
    today: Column,
    now: Column | None = None,
    companies: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Raw postings to typed rows; rows without title or link are dropped.

    ``today`` is the capture date (relative ages count from it), ``now`` bounds
    timestamps.  ``companies(company_id, career_url)`` resolves relative links.
    """
    now = F.to_timestamp(F.date_add(today, 1)) if now is None else now
    source = as_raw(raw)
    base = F.lit(None).cast("string")
    if companies is not None:
        source = source.join(companies.select("company_id", "career_url"), "company_id", "left")
        base = F.col("career_url")
    parts, output = _normal_form()
    rows = source.filter((F.col("url") != "") & ~is_blank(F.col("title"))).withColumns(
        {"__base": base, "__today": today, "__now": now}
    )
    asked = [Part(p.inputs, p.steps, (*p.outputs, *[c for c in p.inputs if c in keep])) for p in parts]
    link = canonicalize_url(F.col("url"), F.coalesce(F.col("__base"), F.lit("")))
    return with_parts(rows, asked).withColumn("url", link).select(*output, *keep)


@per_context
def _normal_form() -> tuple[list[Part], list[Column]]:
    """What ``normalize_postings`` makes of the texts, the place, the pay and the date of a posting, and its columns."""
    col = F.col
    title, description, place, pay = (col(c) for c in ("title", "description", "__place", "__pay"))
    parts = [
        Part(("title", "employment_type", "description", "requirements"), (
            {c: clean_text(col(c)) for c in ("title", "description", "requirements")},
            {
                "__title_key": normalize_key(title), "description": blank_to_null(description),
                "requirements": blank_to_null(col("requirements")),
            },
            {
                "__title": truncate(title, V.TITLE_LIMIT),
                "__employment": parse_employment_type(col("employment_type"), title, description),
                "__seniority": parse_seniority(title, description, col("__title_key")),
                "__skills": detect_skills(title, description, col("requirements")),
            },
        ), ("__title_key", "description", "requirements", "__title", "__employment", "__seniority", "__skills")),
        Part(("location", "remote"), (
            {"location": clean_text(col("location"))},
            {"__place": parse_location(col("location"), col("remote"))},
            {"__place_key": normalize_key(place["raw"]), "__place_raw": truncate(place["raw"], V.LOCATION_LIMIT)},
        ), ("__place", "__place_key", "__place_raw")),
        Part(("salary",), (
            {"salary": clean_text(col("salary"))},
            {"__pay": parse_salary(col("salary"))},
            {"__pay_raw": truncate(pay["raw"], V.SHORT_TEXT_LIMIT)},
        ), ("__pay", "__pay_raw")),
        Part(("posted_at", "__today", "__now"), (
            {
                "__posted_date": parse_posted_date(col("posted_at"), col("__today")),
                "__posted_at": parse_posted_datetime(col("posted_at"), col("__now")),
            },
        ), ("__posted_date", "__posted_at")),
    ]
    output = [
        content_hash(
            col("company_id"), col("__title_key"), col("__place_key"), col("url"), col("external_id"),
        ).alias("content_hash"),
        col("company_id"),
        truncate(col("external_id"), V.SHORT_TEXT_LIMIT).alias("external_job_id"),
        col("__title").alias("title"),
        truncate(col("url"), V.URL_LIMIT).alias("url"),
        col("__place_raw").alias("location_raw"),
        place["city"].alias("location_city"),
        place["region"].alias("location_region"),
        place["country"].alias("location_country"),
        place["remote_type"].alias("remote_type"),
        col("__employment").alias("employment_type"),
        col("__seniority").alias("seniority"),
        col("description"),
        col("requirements"),
        col("__skills").alias("detected_skills"),
        pay["minimum"].alias("salary_min"),
        pay["maximum"].alias("salary_max"),
        pay["currency"].alias("salary_currency"),
        pay["period"].alias("salary_period"),
        col("__pay_raw").alias("salary_raw"),
        col("__posted_date").alias("posted_date"),
        col("__posted_at").alias("posted_at"),
        col("tier").alias("extraction_tier"),
    ]
    return parts, output


def hashed_postings(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Only the identity of raw postings: what deduplication needs."""
    source = as_raw(raw).filter((F.col("url") != "") & ~is_blank(F.col("title"))).withColumns({
        "title": clean_text(F.col("title")),
        "location": clean_text(F.col("location")),
    })
    return source.select(
        content_hash(
            F.col("company_id"), normalize_key(F.col("title")), normalize_key(F.col("location")),
            canonicalize_url(F.col("url")), F.col("external_id"),
        ).alias("content_hash"),
        "company_id", *keep,
    )


def within_batch_dedup(batch: DataFrame, order: Sequence[Column], keys: Sequence[str] = KEY) -> DataFrame:
    return first_per_key(batch, keys, order)


def new_postings(batch: DataFrame, stored: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows of the batch whose key is not stored; the first of each key wins."""
    fresh = within_batch_dedup(batch, order)
    return fresh.join(stored.select(*KEY), list(KEY), "left_anti")


def touch_seen(
    stored: DataFrame, batch: DataFrame, seen_at: Column, reactivate: bool = False
) -> DataFrame:
    """``last_seen_at`` of stored postings present in the batch moves to ``seen_at``.

    A closed posting that comes back stays closed unless ``reactivate`` is set.
    """
    present = batch.select(*KEY).distinct().withColumn("__seen", F.lit(True))
    seen = F.col("__seen").isNotNull()
    out = stored.join(present, list(KEY), "left").withColumn(
        "last_seen_at", F.when(seen, seen_at).otherwise(F.col("last_seen_at"))
    )
    if reactivate:
        out = out.withColumn("is_active", F.col("is_active") | seen)
    return out.drop("__seen")


def two_loads(rows: DataFrame, is_new: Column, order: Sequence[Column], captured: Column, seen_at: Column) -> DataFrame:
    """Stored postings after a first load and a second one (``is_new``), as ``new_postings`` and ``touch_seen`` leave them.

    One aggregate: a row is read and moved once, and a key with many rows is cut in each map task.  Rows whose
    ``is_new`` is null belong to no load.
    """
    first, at = F.col("__first"), F.col("__first.__at")
    kept = rows.withColumn("__new", is_new).filter("__new IS NOT NULL").groupBy(*KEY).agg(
        F.min(F.struct("__new", *order, captured.alias("__at"))).alias("__first"), F.max("__new").alias("__seen"),
    )
    touched = ~first["__new"] & F.col("__seen")
    return kept.select(*KEY, at.alias("first_seen_at"), F.when(touched, seen_at).otherwise(at).alias("last_seen_at"))


def touched_by_second(rows: DataFrame, is_new: Column, captured: Column, seen_at: Column) -> DataFrame:
    """``last_seen_at`` of the postings of a first load after a second one (``is_new``), as ``touch_seen`` leaves it.

    One aggregate over both loads, as in ``two_loads``.
    """
    kept = rows.withColumns({"__new": is_new, "__at": captured}).groupBy(*KEY).agg(
        F.max(F.when(~F.col("__new"), F.col("__at"))).alias("__last"), F.max("__new").alias("__seen"),
        F.min("__new").alias("__only_new"),
    ).filter(~F.col("__only_new"))
    return kept.select(*KEY, F.when(F.col("__seen"), seen_at).otherwise(F.col("__last")).alias("last_seen_at"))


def stale_reap(stored: DataFrame, now: Column, days: int = V.STALE_AFTER_DAYS) -> DataFrame:
    """Close postings unseen for ``days``; rows are kept."""
    stale = F.col("last_seen_at") < now - F.make_dt_interval(days=F.lit(days))
    return stored.withColumn("is_active", F.col("is_active") & ~stale)


def open_duration(stored: DataFrame) -> DataFrame:
    return stored.withColumn(
        "open_days", F.date_diff(F.to_date("last_seen_at"), F.to_date("first_seen_at"))
    )


def postings_filter(
    postings: DataFrame,
    company_id: int | None = None,
    location: str | None = None,
    remote_type: str | None = None,
    title_contains: str | None = None,
    is_active: bool | None = True,
    since: Column | None = None,
) -> DataFrame:
    """Listing filters; ``%`` and ``_`` in user text stay wildcards."""
    out = postings
    if company_id is not None:
        out = out.filter(F.col("company_id") == company_id)
    if is_active is not None:
        out = out.filter(F.col("is_active") == is_active)
    if remote_type is not None:
        out = out.filter(F.col("remote_type") == remote_type)
    if location:
        pattern = f"%{location.lower()}%"
        out = out.filter(
            F.lower("location_raw").like(pattern) | F.lower("location_city").like(pattern)
            | F.lower("location_country").like(pattern)
        )
    if title_contains:
        out = out.filter(F.lower("title").like(f"%{title_contains.lower()}%"))
    if since is not None:
        out = out.filter(F.col("first_seen_at") >= since)
    return out


def new_since(postings: DataFrame, now: Column, hours: int) -> DataFrame:
    since = now - F.make_dt_interval(hours=F.lit(hours))
    return postings_filter(postings, since=since)


def count_since(postings: DataFrame, now: Column, hours: int) -> DataFrame:
    since = now - F.make_dt_interval(hours=F.lit(hours))
    return postings.filter(F.col("first_seen_at") >= since).agg(F.count(F.lit(1)).alias("n"))


def skill_token_join(texts: DataFrame, key: str, text: str, table: dict[str, str] | None = None) -> DataFrame:
    """``(key, skills)`` by an equi join of word shingles with the dictionary.

    ``table`` maps folded terms to names, by default the fixed list of under a hundred; its longest term
    says how many words a shingle has.  Each text is folded once.  Texts without any term give no row.
    """
    table = table or skill_dictionary()
    longest = max(len(k.split(" ")) for k in table)
    spark = texts.sparkSession
    dictionary = spark.createDataFrame(
        [(k, name, i) for i, (k, name) in enumerate(table.items())],
        "shingle string, skill string, rank int",
    )
    shingles = texts.select(
        key, F.explode(F.array_distinct(token_shingles(normalize_key(F.col(text)), longest))).alias("shingle")
    )
    hits = shingles.join(F.broadcast(dictionary), "shingle")
    found = hits.groupBy(key).agg(F.collect_set(F.struct("rank", "skill")).alias("found"))
    return found.select(
        key, F.transform(F.array_sort("found"), lambda s: s["skill"]).alias("skills")
    )
