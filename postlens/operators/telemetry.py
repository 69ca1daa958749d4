"""Run telemetry: summaries, counters, schedules, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens.functions import fixed_values as V
from postlens.operators.common import before_slice, ordered_slices, running_totals, top_per_key, totals_in_slices
from postlens.tables import written

OK_STATUSES = ("success", "partial")
RUN_ORDER = ("started_at", "run_id")


def _position() -> Column:
    return F.struct(*RUN_ORDER)


def in_window(runs: DataFrame, now: Column, hours: int, column: str = "started_at") -> DataFrame:
    return runs.filter(F.col(column) >= now - F.make_dt_interval(hours=F.lit(hours)))


def run_summary(runs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Totals of a window.  Cost is kept in 1e-4 USD so that sums are exact."""

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    return in_window(runs, now, hours).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "failed").alias("failed_pages"),
        total("jobs_found").alias("jobs_found"), total("jobs_new").alias("new_jobs"),
        total("jobs_duplicate").alias("duplicates"), total("llm_calls").alias("llm_calls"),
        (total("llm_cost_e4") / 10_000).alias("llm_cost_usd"),
        F.bround(F.coalesce(F.avg("total_ms"), F.lit(0.0)), 1).alias("avg_scrape_ms"),
    )


def runs_by_tier(runs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    tier = F.coalesce("extraction_tier", F.lit("None")).alias("tier")
    return in_window(runs, now, hours).groupBy(tier).agg(F.count(F.lit(1)).alias("runs"))


def delivery_summary(notifications: DataFrame, since: Column | None = None) -> DataFrame:
    rows = notifications if since is None else notifications.filter(F.col("created_at") >= since)
    sent, total = F.count_if(F.col("status") == "sent"), F.count(F.lit(1))
    return rows.agg(
        total.alias("total"), sent.alias("sent"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "suppressed").alias("suppressed"),
        F.bround(F.try_divide(sent, total), 4).alias("success_rate"),
    )


def status_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def fleet_overview(
    companies: DataFrame, postings: DataFrame, runs: DataFrame, notifications: DataFrame,
    now: Column, hours: int = 24,
) -> DataFrame:
    """One row over the whole fleet; each figure is its own scalar aggregate."""
    since = now - F.make_dt_interval(hours=F.lit(hours))
    count = F.count(F.lit(1))
    delivery = delivery_summary(notifications, since)
    row = run_summary(runs, now, hours)
    figures = {
        "companies_active": companies.filter("is_active").agg(count).scalar(),
        "companies_total": companies.agg(count).scalar(),
        "jobs_total": postings.agg(count).scalar(),
        "jobs_new_in_window": postings.filter(F.col("first_seen_at") >= since).agg(count).scalar(),
        "notifications_sent": delivery.select("sent").scalar(),
        "success_rate": delivery.select("success_rate").scalar(),
    }
    return row.withColumns(figures)


def portal_key_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Event counter: rows per label combination."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def duration_histogram(
    runs: DataFrame, label: str, seconds: Column, buckets=V.DURATION_BUCKETS
) -> DataFrame:
    """Cumulative bucket counts per label, plus count and sum."""
    counts = [F.count_if(seconds <= b).alias(f"le_{b:g}".replace(".", "_")) for b in buckets]
    micros = F.sum(F.rint(seconds * 1_000_000).cast("long"))     # whole, so that the order of addition does not show
    return runs.groupBy(label).agg(*counts, F.count(F.lit(1)).alias("n"), (micros / 1_000_000).alias("total_seconds"))


def usage_tally(runs: DataFrame) -> DataFrame:
    return runs.groupBy("company_id").agg(
        F.sum("llm_calls").alias("calls"), (F.sum("llm_cost_e4") / 10_000).alias("cost_usd")
    )


def run_close(runs: DataFrame) -> DataFrame:
    """``total_ms`` between start and finish."""
    micros = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(
        F.col("started_at").cast("timestamp")
    )
    return runs.withColumn("total_ms", F.floor(micros / 1_000))


def first_scan_flag(runs: DataFrame) -> DataFrame:
    """``baseline`` is true until a company has had a success or partial run.

    The first good run per company is an aggregate; no per-company sort is needed.
    """
    good = runs.filter(F.col("status").isin(*OK_STATUSES))
    first_ok = good.groupBy("company_id").agg(F.min(_position()).alias("__first"))
    later = F.col("__first").isNotNull() & (_position() > F.col("__first"))
    return (
        runs.join(first_ok, "company_id", "left").withColumn("baseline", ~F.coalesce(later, F.lit(False)))
        .drop("__first")
    )


def schedule_next(runs: DataFrame, bucket: Column, interval_minutes: int = 60) -> DataFrame:
    """Failure streak, next scan time and deactivation after every run.

    Streaks are counted inside (company, time bucket) and continued from earlier
    buckets through a small frame of bucket summaries, so no company is one task.
    """
    failed = (F.col("status") == "failed").cast("int")
    parts = runs.withColumns({"__bucket": bucket, "__failed": failed})
    inside = (
        Window.partitionBy("company_id", "__bucket").orderBy(*RUN_ORDER)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = parts.withColumn("__f", F.sum("__failed").over(inside))
    local = local.withColumn(
        "__f_ok", F.max(F.when(F.col("__failed") == 0, F.col("__f"))).over(inside)
    )
    summary = local.groupBy("company_id", "__bucket").agg(
        F.max("__f").alias("fails"), F.max("__f_ok").alias("fails_at_ok")
    )
    before = Window.partitionBy("company_id").orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    summary = summary.withColumn("__prev", F.coalesce(F.sum("fails").over(before), F.lit(0)))
    summary = summary.withColumn(
        "__prev_ok", F.coalesce(F.max(F.col("__prev") + F.col("fails_at_ok")).over(before), F.lit(0))
    ).drop("fails", "fails_at_ok")
    joined = local.join(summary, ["company_id", "__bucket"])
    at_ok = F.greatest(F.col("__prev_ok"), F.coalesce(F.col("__prev") + F.col("__f_ok"), F.lit(0)))
    streak = (F.col("__prev") + F.col("__f") - at_ok).cast("int")
    minutes = F.least(
        F.lit(interval_minutes) * F.pow(F.lit(2), F.least(F.col("streak"), F.lit(20))),
        F.lit(V.MAX_BACKOFF_MINUTES),
    )
    wait = F.when(F.col("streak") > 0, minutes).otherwise(F.lit(interval_minutes)).cast("int")
    return (
        joined.withColumn("streak", streak)
        .withColumns({
            "next_scan_at": F.col("started_at") + F.make_dt_interval(mins=wait),
            "deactivate": F.col("streak") >= V.MAX_COMPANY_FAILURES,
        })
        .drop("__bucket", "__failed", "__f", "__f_ok", "__prev", "__prev_ok")
    )


def daily_spend(calls: DataFrame, limit_e4: int) -> DataFrame:
    """Running model cost per UTC day with exhausted flag and remainder.

    ``calls(ts, call_id, cost_e4)``; slices of a day are summed apart and chained, so an hour with all
    calls of a day is split as well.
    """
    day = calls.withColumn("day", F.to_date("ts"))
    out = running_totals(
        day, ["day"], ["ts", "call_id"], {"spent_e4": F.col("cost_e4"), "calls_today": F.lit(1)}
    )
    return out.withColumns({
        "exhausted": F.col("spent_e4") >= limit_e4,
        "remaining_e4": F.greatest(F.lit(limit_e4) - F.col("spent_e4"), F.lit(0)),
    })


def breaker_episodes(calls: DataFrame) -> DataFrame:
    """Runs of failures, with gaps up to the cooldown, that reach the threshold.

    ``calls(ts, call_id, ok)``.  A success or a longer gap resets the count.  The
    ledger has no key, so order is taken inside slices of time, and the last call of
    the slices before and their number of runs are carried over by a scan in levels.
    """
    parts = ordered_slices(calls.select("ts", "call_id", "ok"), ["ts", "call_id"])
    inside = Window.partitionBy("slice").orderBy("ts", "call_id")
    tails = written(parts.groupBy("slice").agg(F.max(F.struct("ts", "call_id", "ok")).alias("tail")), "slice-tails")
    previous = F.coalesce(F.lag(F.struct("ts", "call_id", "ok")).over(inside), F.col("tail"))
    chained = parts.join(before_slice(tails, [], maxima=["tail"]), "slice").withColumn("prev", previous)
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev.ts").cast("timestamp"))
    fresh = F.col("prev").isNull() | F.col("prev.ok") | (gap > V.BREAKER_COOLDOWN_SECONDS * 1_000_000)
    failures = written(
        chained.filter(~F.col("ok")).select("ts", "call_id", "slice", fresh.cast("int").alias("starts")), "failures"
    )
    islands = totals_in_slices(failures, [], ["ts", "call_id"], {"island": F.col("starts")})
    reached = islands.groupBy("island").agg(
        F.count(F.lit(1)).alias("failures"), F.max("ts").alias("last_failure_at")
    ).filter(F.col("failures") >= V.BREAKER_FAILURES)
    opening = top_per_key(
        islands.select("island", F.col("ts").alias("opened_at"), "call_id"), ["island"],
        [F.col("opened_at"), F.col("call_id")], V.BREAKER_FAILURES, rank="nth",
    ).filter(F.col("nth") == V.BREAKER_FAILURES).drop("nth", "call_id")
    return reached.join(opening, "island").select(
        "opened_at", "failures",
        (F.col("last_failure_at") + F.make_dt_interval(secs=F.lit(V.BREAKER_COOLDOWN_SECONDS)))
        .alias("closes_at"),
    )


def politeness_audit(requests: DataFrame, limit: int = V.REQUESTS_PER_MINUTE) -> DataFrame:
    """Requests per domain in the 60 seconds up to each request.

    Each request is copied into its own and the next minute, so that a task holds
    two minutes of a domain, never the whole domain.
    """
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    minute = F.floor(second / 60)
    copies = requests.withColumns({"__second": second, "__own": minute}).withColumn(
        "__minute", F.explode(F.array(F.col("__own"), F.col("__own") + 1))
    )
    trailing = Window.partitionBy("domain", "__minute").orderBy("__second").rangeBetween(-59, 0)
    counted = copies.withColumn("in_last_minute", F.count(F.lit(1)).over(trailing))
    return (
        counted.filter(F.col("__minute") == F.col("__own"))
        .withColumn("over_limit", F.col("in_last_minute") > limit)
        .drop("__second", "__own", "__minute")
    )


def match_counts(matches: DataFrame, threshold: float = V.MATCH_THRESHOLD) -> DataFrame:
    """Strong and weak matches per company."""
    strong = F.col("score") >= threshold
    return matches.groupBy("company_id").agg(
        F.count_if(strong).alias("strong"), F.count_if(~strong).alias("weak"),
        F.count(F.lit(1)).alias("total"), F.max("score").alias("best_score"),
    )


def scan_report(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Outcome per run: counts, tier, confidence, baseline flag, status.

    ``scores(run_id, confidence, acceptable)`` comes from the extraction score.
    """
    flagged = first_scan_flag(runs).join(scores, "run_id", "left")
    status = (
        F.when(F.col("jobs_found") == 0, "failed").when(F.col("acceptable"), "success").otherwise("partial")
    )
    return flagged.select(
        "run_id", "company_id", "jobs_found", "jobs_new", "jobs_duplicate",
        F.col("extraction_tier").alias("tier"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "baseline", status.alias("status"),
    )
