"""Extraction score per batch and the choice of an extraction tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlens.functions import fixed_values as V
from postlens.functions.plausibility import looks_like_title, title_key

# Field weights in ten-thousandths.
WEIGHTS = {
    "title": 3_500, "url": 2_500, "location": 1_000, "posted_at": 500, "description": 500,
    "plausible": 2_000,
}


def extraction_score(batch: DataFrame, *keys: str) -> DataFrame:
    """Confidence of each batch (one per key), with missing shares and reasons.

    Rows are first grouped by (key, folded title, link), which also gives the most
    common title, so a hot batch is already small when its totals are taken.
    """

    def filled(name: str) -> Column:
        return F.count_if(F.trim(F.coalesce(F.col(name), F.lit(""))) != "")

    titled = batch.withColumns({
        "__title": title_key(F.col("title")), "__good": looks_like_title(F.col("title")),
        "url": F.when(F.col("url") != "", F.col("url")),
    })
    by_link = titled.groupBy(*keys, "__title", "url").agg(
        F.count(F.lit(1)).alias("n"), filled("title").alias("title"), filled("url").alias("n_url"),
        filled("location").alias("location"), filled("posted_at").alias("posted_at"),
        filled("description").alias("description"), F.count_if("__good").alias("plausible"),
    )
    by_title = by_link.groupBy(*keys, "__title").agg(
        *[F.sum(c).alias(c) for c in ("n", "title", "n_url", "location", "posted_at", "description", "plausible")],
        F.min("url").alias("min_url"), F.max("url").alias("max_url"),
    )
    total = by_title.groupBy(*keys).agg(
        F.sum("n").alias("jobs_found"), F.max("n").alias("modal"),
        F.sum("n_url").alias("url"),
        *[F.sum(c).alias(c) for c in ("title", "location", "posted_at", "description", "plausible")],
        F.min("min_url").alias("min_url"), F.max("max_url").alias("max_url"),
    )
    n = F.col("jobs_found")
    weighted = sum((F.col(name) * w for name, w in WEIGHTS.items()), F.lit(0))
    implausible = 2 * F.col("plausible") < n
    repeated = (n >= 3) & (2 * F.col("modal") > n)
    one_link = (F.col("min_url") == F.col("max_url")) & (n > 1)
    one_link = F.coalesce(one_link, F.lit(False))
    # Factors .5, .4 and .3 in tenths, so the division happens once, half up.
    tenths = (
        F.when(implausible, 5).otherwise(10) * F.when(repeated, 4).otherwise(10)
        * F.when(one_link, 3).otherwise(10)
    )
    numerator = (weighted * tenths).cast("decimal(38,0)")
    e4 = F.floor((2 * numerator + 1_000 * n) / (2_000 * n)).cast("int")
    reasons = F.array_compact(F.array(
        F.when(implausible, "most titles do not read like job titles"),
        F.when(repeated, "more than half the titles are identical"),
        F.when(one_link, "every posting points at the same URL"),
        F.when(2 * F.col("url") < n, "most postings have no link"),
    ))
    missing = {
        f"missing_{c}_e3": F.rint(1_000 * (n - F.col(c)) / n).cast("int")
        for c in ("title", "url", "location", "posted_at", "description")
    }
    scored = total.withColumns({"confidence_e4": e4, "reasons": reasons, **missing})
    return scored.withColumn("confidence", F.col("confidence_e4") / 10_000).select(
        *keys, "jobs_found", "confidence_e4", "confidence", "reasons", *missing
    )


def is_acceptable() -> Column:
    return (F.col("jobs_found") >= V.MIN_POSTINGS) & (F.col("confidence_e4") >= round(V.MIN_CONFIDENCE * 10_000))


def acceptable(scores: DataFrame) -> DataFrame:
    return scores.filter(is_acceptable())


def ladder_choice(scores: DataFrame, key: str) -> DataFrame:
    """First acceptable tier per company and the trail of attempts up to it."""
    order = F.array_position(F.array(*[F.lit(t) for t in V.TIER_ORDER]), F.col("tier"))
    ranked = scores.withColumns({"__rank": order, "__ok": is_acceptable()})
    step = F.struct(
        F.col("__rank").alias("rank"),
        F.concat(
            F.col("tier"), F.when(F.col("__ok"), ":ok(").otherwise(":miss("),
            F.col("jobs_found").cast("string"), F.lit(")"),
        ).alias("text"),
    )
    grouped = ranked.groupBy(key).agg(
        F.min_by("tier", F.when(F.col("__ok"), F.col("__rank"))).alias("tier"),
        F.min(F.when(F.col("__ok"), F.col("__rank"))).alias("__won"),
        F.array_sort(F.collect_list(step)).alias("__steps"),
    )
    tried = F.filter("__steps", lambda s: F.col("__won").isNull() | (s["rank"] <= F.col("__won")))
    return grouped.withColumns({
        "trail": F.transform(tried, lambda s: s["text"]),
        "tier": F.when(F.col("__won").isNotNull(), F.col("tier")),
    }).select(key, "tier", "trail")


def should_regenerate(companies: DataFrame, selectors: DataFrame) -> DataFrame:
    """Websites without a selector, or whose selector fails in a row too often."""
    state = selectors.select("website", "consecutive_failures", F.lit(True).alias("__has"))
    joined = companies.select("website").distinct().join(state, "website", "left")
    worn = F.col("consecutive_failures") >= V.RELEARN_AFTER_FAILURES
    return joined.select("website", (F.col("__has").isNull() | worn).alias("regenerate"))
