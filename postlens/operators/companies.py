"""Companies, profiles and run listings: filters, joins and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlens.functions import fixed_values as V
from postlens.functions.urls import canonicalize_url
from postlens.operators.common import first_per_key


def companies_filter(companies: DataFrame, platform: str | None = None, is_active: bool | None = None) -> DataFrame:
    out = companies
    if platform is not None:
        out = out.filter(F.col("ats_type") == platform)
    if is_active is not None:
        out = out.filter(F.col("is_active") == is_active)
    return out.orderBy("name")


def due_for_scan(companies: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Active companies whose time has come, never-scanned ones first."""
    due = F.col("next_scan_at").isNull() | (F.col("next_scan_at") <= now)
    ordered = companies.filter("is_active").filter(due).orderBy(F.col("next_scan_at").asc_nulls_first(), "company_id")
    return ordered if limit is None else ordered.limit(limit)


def posting_company(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Company name per posting, "Unknown" when absent."""
    names = companies.select("company_id", F.col("name").alias("__name"))
    return (
        postings.join(names, "company_id", "left")
        .withColumn("company_name", F.coalesce("__name", F.lit("Unknown"))).drop("__name")
    )


def group_by_company(rows: DataFrame, ties: list[str]) -> DataFrame:
    """Rank inside each company by score and rank companies by their best score.

    ``rows`` is a report page (already limited), so a company is at most one page.
    """
    from pyspark.sql import Window

    inside = Window.partitionBy("company_name")
    return rows.withColumns({
        "best_score": F.max("score").over(inside),
        "rank_in_company": F.row_number().over(inside.orderBy(F.col("score").desc(), *ties)),
    }).orderBy(F.col("best_score").desc(), "company_name", "rank_in_company")


def user_profiles(users: DataFrame, profiles: DataFrame, required: bool = True) -> DataFrame:
    """Active users with their profile; ``required`` skips users without one."""
    return users.filter("is_active").join(profiles, "user_id", "inner" if required else "left")


def latest_run(runs: DataFrame) -> DataFrame:
    return first_per_key(runs, ["company_id"], [F.col("started_at").desc(), F.col("run_id").desc()])


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(n)


def posting_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if("is_active").alias("active_jobs")
    )


def company_detail(
    companies: DataFrame, postings: DataFrame, runs: DataFrame, selectors: DataFrame
) -> DataFrame:
    """Company with posting counts, last run and the confidence of its selector."""
    from postlens.operators.selectors import active_selector

    last = latest_run(runs).select(
        "company_id", F.col("status").alias("last_run_status"),
        F.col("jobs_found").alias("last_run_jobs_found"),
        F.col("extraction_tier").alias("last_run_tier"),
    )
    chosen = active_selector(selectors).select(
        "website", F.col("confidence").alias("selector_confidence")
    )
    return (
        companies.join(posting_counts(postings), "company_id", "left")
        .join(last, "company_id", "left").join(chosen, "website", "left")
        .withColumns({
            "total_jobs": F.coalesce("total_jobs", F.lit(0)),
            "active_jobs": F.coalesce("active_jobs", F.lit(0)),
        })
    )


def status_report(companies: DataFrame, runs: DataFrame) -> DataFrame:
    """Active companies with status and count of their last run, in one join."""
    last = latest_run(runs).select("company_id", "status", "jobs_found")
    return (
        companies.filter("is_active").join(last, "company_id", "left")
        .select(
            "company_id", "name", "ats_type",
            F.coalesce("status", F.lit("-")).alias("last_run"),
            F.coalesce("jobs_found", F.lit(0)).alias("jobs"),
        )
    )


def seed_reconcile(seeds: DataFrame, companies: DataFrame, interval_minutes: int) -> DataFrame:
    """Desired portals against registered ones, with the change each needs.

    ``seeds(url, name)``, ``companies(career_url, name, scrape_interval_minutes)``.
    """
    wanted = seeds.select(canonicalize_url(F.col("url")).alias("career_url"), F.col("name").alias("seed_name"))
    known = companies.select("career_url", "name", "scrape_interval_minutes", F.lit(True).alias("__known"))
    wanted = first_per_key(wanted, ["career_url"], [F.col("seed_name").asc_nulls_last()])
    both = wanted.withColumn("__wanted", F.lit(True)).join(known, "career_url", "full")
    rename = F.col("seed_name").isNotNull() & (F.col("seed_name") != F.col("name"))
    cadence = F.col("scrape_interval_minutes") != interval_minutes
    action = (
        F.when(F.col("__known").isNull(), "insert").when(F.col("__wanted").isNull(), "keep")
        .when(rename & cadence, "rename+cadence").when(rename, "rename")
        .when(cadence, "cadence").otherwise("keep")
    )
    return both.select(
        "career_url", F.coalesce("seed_name", "name").alias("name"), action.alias("action"),
        F.when(F.col("__wanted").isNull(), F.col("scrape_interval_minutes"))
        .otherwise(F.lit(interval_minutes)).alias("scrape_interval_minutes"),
    )


def portal_totals(rows: DataFrame) -> DataFrame:
    """Portals with jobs of those scanned, and what the scan found in all."""
    scanned = F.coalesce(F.col("extraction_tier"), F.lit("")) != "skipped"
    return rows.agg(
        F.count_if(scanned & (F.col("jobs_found") > 0)).alias("portals_with_jobs"),
        F.count_if(scanned).alias("portals_scanned"),
        F.coalesce(F.sum("jobs_found"), F.lit(0)).alias("found"),
        F.coalesce(F.sum("jobs_new"), F.lit(0)).alias("new"),
        F.coalesce(F.sum("llm_calls"), F.lit(0)).alias("model_calls"),
    )
