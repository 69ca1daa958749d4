"""Run, selector, budget and notification telemetry over the derived logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.functions import fixed_values as V
from postlens.operators import common, notifications as N, selectors as L, telemetry as T
from postlens.operators.extraction import acceptable, extraction_score, ladder_choice, should_regenerate
from postlens.operators.prices import price_lookup
from postlens.plans.sources import raw_postings, spread
from postlens.plans.views import view, with_views
from postlens.session import prepare

col = F.col
NOW = "2024-01-31 00:00:00"


def _ts(text: str = NOW):
    return F.lit(text).cast("timestamp_ntz")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(view(prepare(spark), sf, "v_runs"))


def _v(name):
    return lambda spark, sf: spread(view(prepare(spark), sf, name))


_attempts, _selectors, _notes, _companies = (
    _v(n) for n in ("v_attempts", "v_selectors", "v_notifications", "v_companies")
)


def run_summary(spark, sf):
    return T.run_summary(_runs(spark, sf), _ts(), 720)


def runs_by_tier(spark, sf):
    return T.runs_by_tier(_runs(spark, sf), _ts(), 720)


def delivery_summary(spark, sf):
    return T.delivery_summary(_notes(spark, sf))


def status_counts(spark, sf):
    return T.status_counts(_notes(spark, sf))


def fleet_overview(spark, sf):
    posts = raw_postings(spark, sf).select(col("seen_at").alias("first_seen_at"))
    return T.fleet_overview(
        _companies(spark, sf), posts, _runs(spark, sf), _notes(spark, sf), _ts("2000-01-01 00:00:00"), 240
    ).select(
        "companies_active", "companies_total", "jobs_total", "jobs_new_in_window",
        "notifications_sent", "success_rate", "runs", "jobs_found",
    )


def portal_totals(spark, sf):
    from postlens.operators.companies import latest_run, portal_totals as totals

    return totals(latest_run(_runs(spark, sf)))


def duration_histogram(spark, sf):
    runs = _runs(spark, sf).join(_companies(spark, sf).select("company_id", "ats_type"), "company_id")
    return T.duration_histogram(runs, "ats_type", col("total_ms") / 1000)


def event_counters(spark, sf):
    runs = _runs(spark, sf).join(_companies(spark, sf).select("company_id", "ats_type"), "company_id")
    tiers = T.portal_key_counts(runs, "ats_type", "extraction_tier", "status")
    notes = T.portal_key_counts(_notes(spark, sf), "channel", "status").select(
        F.lit("notification").alias("ats_type"), col("channel").alias("extraction_tier"), "status", "n"
    )
    return tiers.unionByName(notes)


def usage_tally(spark, sf):
    return T.usage_tally(_runs(spark, sf))


def run_close(spark, sf):
    runs = _runs(spark, sf).drop("total_ms").withColumn(
        "finished_at", col("started_at") + F.make_dt_interval(secs=(col("jobs_found") * 7 % 100) + F.lit(0.5))
    )
    return T.run_close(runs).select("run_id", "total_ms")


def first_scan_flag(spark, sf):
    return T.first_scan_flag(_runs(spark, sf)).select("run_id", "baseline")


def schedule_next(spark, sf):
    return T.schedule_next(_runs(spark, sf), F.date_trunc("day", "started_at"), 60).select(
        "run_id", "streak", "next_scan_at", "deactivate"
    )


def _calls(spark, sf):
    return _runs(spark, sf).filter("llm_calls = 1").select(
        col("started_at").alias("ts"), col("run_id").alias("call_id"),
        (col("status") != "failed").alias("ok"), col("llm_cost_e4").alias("cost_e4"),
    )


def daily_spend(spark, sf):
    return T.daily_spend(_calls(spark, sf), 2_000).select(
        "call_id", "spent_e4", "calls_today", "exhausted", "remaining_e4"
    )


def breaker_episodes(spark, sf):
    """Over all runs: gaps between failures are longer than in a live call log, so
    seconds are compressed by a factor of 100 to make episodes appear."""
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    calls = _runs(spark, sf).select(
        F.timestamp_micros(
            (F.unix_micros(base) + F.floor((F.unix_micros(col("started_at").cast("timestamp")) - F.unix_micros(base)) / 100)).cast("bigint")
        ).cast("timestamp_ntz").alias("ts"),
        col("run_id").alias("call_id"), (col("jobs_found") % 3 == 0).alias("ok"),
    )
    return T.breaker_episodes(calls)


def politeness_audit(spark, sf):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    log = _attempts(spark, sf).select(
        "attempt_id", col("website").alias("domain"),
        F.timestamp_seconds(
            F.unix_timestamp(base) + F.floor((F.unix_timestamp(col("ts").cast("timestamp")) - F.unix_timestamp(base)) / 500)
        ).alias("ts"),
    )
    return T.politeness_audit(log).select("attempt_id", "in_last_minute", "over_limit")


def selector_health(spark, sf):
    attempts = _attempts(spark, sf).withColumn("confidence_e4", col("confidence_pct") * 100)
    return L.selector_health(attempts)


def regenerate(spark, sf):
    """Websites whose number ends in 0 or 5 have no stored selector."""
    stored = selector_health(spark, sf).filter(~col("website").rlike(r"[05]\.example"))
    return should_regenerate(_companies(spark, sf), stored)


def selector_success_rate(spark, sf):
    return L.selector_success_rate(_attempts(spark, sf))


def degraded_selectors(spark, sf):
    return L.degraded_selectors(_selectors(spark, sf)).select("website", "version", "confidence")


def relearn_candidates(spark, sf):
    return L.relearn_candidates(_selectors(spark, sf), _companies(spark, sf), limit=20).select(
        "website", "version", "company_id", "name"
    )


def next_version(spark, sf):
    return L.next_version(_selectors(spark, sf))


def selector_versions(spark, sf):
    return L.selector_versions(_selectors(spark, sf), keep=2).select("website", "version", "is_active")


def pruned_versions(spark, sf):
    return L.pruned_versions(_selectors(spark, sf), keep=1).select("website", "version", "is_active")


def company_selector(spark, sf):
    return L.company_selector(_companies(spark, sf), _selectors(spark, sf)).select(
        "company_id", "version", "confidence"
    )


def notification_filter(spark, sf):
    rows = N.notification_filter(_notes(spark, sf), channel="email", status="sent", since=_ts("1995-01-01 00:00:00"))
    return common.page_of(rows.select("notification_id", "created_at"), N.newest_first(), limit=100)


def retryable(spark, sf):
    return N.retryable(_notes(spark, sf), limit=V.RETRY_LIMIT).select("notification_id", "attempts")


def notification_log(spark, sf):
    posts = raw_postings(spark, sf).groupBy(F.floor(col("seq") / 1_000_000).alias("job_id")).agg(
        F.min("title").alias("title"), F.min("url").alias("url")
    )
    users = _companies(spark, sf).select(col("company_id").alias("user_id"), col("name").alias("user_name"))
    return N.notification_log(_notes(spark, sf), posts, users).select("notification_id", "title", "url", "user_name")


def unnotified(spark, sf):
    claims = raw_postings(spark, sf).select(
        F.floor(col("seq") / 1_000_000).alias("job_id"), (col("company_id") % 60).alias("user_id"), F.lit("slack").alias("channel")
    )
    return N.unnotified(claims, _notes(spark, sf))


def already_notified(spark, sf):
    return N.already_notified(_notes(spark, sf))


def _batches(spark, sf):
    """Raw postings as extraction results of one tier per company and month."""
    rows = raw_postings(spark, sf)
    month = F.month("seen_at")
    tier = F.element_at(F.array(*[F.lit(t) for t in T.V.TIER_ORDER]), month % 5 + 1)
    return rows.select(
        "company_id", tier.alias("tier"), "url", "location", "posted_at", "description",
        F.when(month % 5 == 0, "Read more").when((month % 5 == 1) & (col("company_id") % 2 == 0), "Openings")
        .otherwise(col("title")).alias("title"),
    )


def extraction_scores(spark, sf):
    return extraction_score(_batches(spark, sf), "company_id", "tier").select(
        "company_id", "tier", "jobs_found", "confidence_e4", "confidence", "missing_location_e3",
        F.array_join("reasons", "|").alias("reasons"),
    )


def acceptable_batches(spark, sf):
    return acceptable(extraction_score(_batches(spark, sf), "company_id", "tier")).select("company_id", "tier")


def ladder(spark, sf):
    return ladder_choice(extraction_score(_batches(spark, sf), "company_id", "tier"), "company_id").select(
        "company_id", "tier", F.array_join("trail", "|").alias("trail")
    )


def scan_report(spark, sf):
    runs = _runs(spark, sf)
    scores = runs.select(
        "run_id", (col("jobs_found") / 100).alias("confidence"), (col("jobs_found") >= 60).alias("acceptable")
    )
    return T.scan_report(runs, scores)


def prices(spark, sf):
    """Parts as model ids, brand prefixes as the price list."""
    parts = view(prepare(spark), sf, "part")
    listed = parts.select(F.concat(F.lit("m-"), F.substring("p_brand", 1, 7)).alias("model_prefix")).distinct().withColumns({
        "price_in": F.length("model_prefix") / 4, "price_out": F.length("model_prefix") / 2,
    }).filter(~col("model_prefix").endswith("3"))
    usage = parts.select(
        "p_partkey", F.concat(F.lit("m-"), "p_brand", F.lit("-"), "p_type").alias("model"),
        (col("p_size") * 1000).alias("tokens_in"), (col("p_size") * 100).alias("tokens_out"),
    )
    return price_lookup(usage, listed).select("p_partkey", "cost_usd")


QUERIES = {
    "run_summary": run_summary, "runs_by_tier": runs_by_tier, "delivery_summary": delivery_summary,
    "status_counts": status_counts, "fleet_overview": fleet_overview, "portal_totals": portal_totals,
    "duration_histogram": duration_histogram, "event_counters": event_counters,
    "usage_tally": usage_tally, "run_close": run_close, "first_scan_flag": first_scan_flag,
    "schedule_next": schedule_next, "daily_spend": daily_spend, "breaker_episodes": breaker_episodes,
    "politeness_audit": politeness_audit, "selector_health": selector_health, "should_regenerate": regenerate,
    "selector_success_rate": selector_success_rate, "degraded_selectors": degraded_selectors,
    "relearn_candidates": relearn_candidates, "next_version": next_version,
    "selector_versions": selector_versions, "pruned_versions": pruned_versions,
    "company_selector": company_selector, "notification_filter": notification_filter,
    "retryable": retryable, "notification_log": notification_log, "unnotified": unnotified,
    "already_notified": already_notified, "extraction_score": extraction_scores,
    "acceptable": acceptable_batches, "ladder_choice": ladder, "scan_report": scan_report,
    "price_lookup": prices,
}


def _sql() -> dict[str, str]:
    from postlens.functions import fixed_values as V
    from postlens.plans import sql as S

    v = with_views
    window = f"started_at >= TIMESTAMP '{NOW}' - INTERVAL 720 HOUR"
    buckets = ", ".join(
        f"count(*) FILTER (total_ms / 1000.0 <= {b}) AS {f'le_{b:g}'.replace('.', '_')}" for b in V.DURATION_BUCKETS
    )
    fleet_since = "TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 240 HOUR"
    calls = "calls AS (SELECT started_at AS ts, run_id AS call_id, status <> 'failed' AS ok, llm_cost_e4 AS cost_e4 FROM v_runs WHERE llm_calls = 1)"
    streaks = """m AS (SELECT *, sum(CASE WHEN status = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY company_id ORDER BY started_at, run_id) AS island FROM v_runs),
        s AS (SELECT *, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY company_id, island ORDER BY started_at, run_id) AS INTEGER) AS streak FROM m),
        w AS (SELECT *, CASE WHEN streak = 0 THEN 60 ELSE least(60 * power(2, least(streak, 20)), 10080) END AS mins FROM s)"""
    title = r"trim(regexp_replace(lower(coalesce(title, '')), '\s+', ' ', 'g'))"

    def any_of(words):
        return "(" + " OR ".join(f"contains(t, {S.text(w)})" for w in words) + ")"

    batches = v("v_postings") + f""", b AS (SELECT company_id, {S.text_list(V.TIER_ORDER)}[month(seen_at) % 5 + 1] AS tier, month(seen_at) % 5 + 1 AS ord, url, location, posted_at, description,
          CASE WHEN month(seen_at) % 5 = 0 THEN 'Read more' WHEN month(seen_at) % 5 = 1 AND company_id % 2 = 0 THEN 'Openings' ELSE title END AS title FROM v_postings),
        f AS (SELECT *, {title} AS t FROM b),
        g AS (SELECT *, length(t) BETWEEN 3 AND 160 AND NOT {any_of(V.CHROME_PHRASES)} AND ({any_of(V.ROLE_WORDS)} OR contains(t, ' ')) AS good FROM f),
        modal AS (SELECT company_id, tier, max(n) AS top FROM (SELECT company_id, tier, t, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL),
        a AS (SELECT company_id, tier, any_value(ord) AS ord, count(*) AS n, count(CASE WHEN trim(title) <> '' THEN 1 END) AS nt, count(CASE WHEN url <> '' THEN 1 END) AS nu,
          count(location) AS nl, count(posted_at) AS nd, count(description) AS nx, count(*) FILTER (good) AS np, count(DISTINCT url) AS du FROM g GROUP BY company_id, tier),
        c AS (SELECT a.*, top, (3500 * nt + 2500 * nu + 1000 * nl + 500 * nd + 500 * nx + 2000 * np)
            * CASE WHEN 2 * np < n THEN 5 ELSE 10 END * CASE WHEN n >= 3 AND 2 * top > n THEN 4 ELSE 10 END * CASE WHEN du = 1 AND n > 1 THEN 3 ELSE 10 END AS num FROM a JOIN modal USING (company_id, tier)),
        d AS (SELECT *, CAST((2 * num + 1000 * n) // (2000 * n) AS INTEGER) AS e4 FROM c)"""
    return {
        "run_summary": v("v_runs") + f""" SELECT count(*) AS runs, count(*) FILTER (status = 'failed') AS failed_pages, CAST(coalesce(sum(jobs_found), 0) AS BIGINT) AS jobs_found,
            CAST(coalesce(sum(jobs_new), 0) AS BIGINT) AS new_jobs, CAST(coalesce(sum(jobs_duplicate), 0) AS BIGINT) AS duplicates, CAST(coalesce(sum(llm_calls), 0) AS BIGINT) AS llm_calls,
            coalesce(sum(llm_cost_e4), 0) / 10000 AS llm_cost_usd, round_even(coalesce(avg(total_ms), 0), 1) AS avg_scrape_ms FROM v_runs WHERE {window}""",
        "runs_by_tier": v("v_runs") + f" SELECT coalesce(extraction_tier, 'None') AS tier, count(*) AS runs FROM v_runs WHERE {window} GROUP BY 1",
        "delivery_summary": v("v_notifications") + """ SELECT count(*) AS total, count(*) FILTER (status = 'sent') AS sent, count(*) FILTER (status = 'failed') AS failed,
            count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'suppressed') AS suppressed, round_even(count(*) FILTER (status = 'sent') / nullif(count(*), 0), 4) AS success_rate FROM v_notifications""",
        "status_counts": v("v_notifications") + " SELECT status, count(*) AS n FROM v_notifications GROUP BY 1",
        "fleet_overview": v("v_companies", "v_postings", "v_runs", "v_notifications") + f""", n AS (SELECT * FROM v_notifications WHERE created_at >= {fleet_since}), r AS (SELECT * FROM v_runs WHERE started_at >= {fleet_since})
            SELECT (SELECT count(*) FROM v_companies WHERE is_active) AS companies_active, (SELECT count(*) FROM v_companies) AS companies_total, (SELECT count(*) FROM v_postings) AS jobs_total,
              (SELECT count(*) FROM v_postings WHERE seen_at >= {fleet_since}) AS jobs_new_in_window, (SELECT count(*) FROM n WHERE status = 'sent') AS notifications_sent,
              (SELECT round_even(count(*) FILTER (status = 'sent') / nullif(count(*), 0), 4) FROM n) AS success_rate, (SELECT count(*) FROM r) AS runs, (SELECT CAST(coalesce(sum(jobs_found), 0) AS BIGINT) FROM r) AS jobs_found""",
        "portal_totals": v("v_runs") + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY started_at DESC, run_id DESC) AS rn FROM v_runs) WHERE rn = 1)
            SELECT count(*) FILTER (jobs_found > 0) AS portals_with_jobs, count(*) AS portals_scanned, CAST(sum(jobs_found) AS BIGINT) AS found, CAST(sum(jobs_new) AS BIGINT) AS new, CAST(sum(llm_calls) AS BIGINT) AS model_calls FROM l""",
        "duration_histogram": v("v_runs", "v_companies") + f" SELECT ats_type, {buckets}, count(*) AS n, CAST(sum(total_ms) AS BIGINT) / 1000 AS total_seconds FROM v_runs JOIN v_companies USING (company_id) GROUP BY 1",
        "event_counters": v("v_runs", "v_companies", "v_notifications") + """ SELECT ats_type, extraction_tier, status, count(*) AS n FROM v_runs JOIN v_companies USING (company_id) GROUP BY ALL
            UNION ALL SELECT 'notification', channel, status, count(*) FROM v_notifications GROUP BY ALL""",
        "usage_tally": v("v_runs") + " SELECT company_id, CAST(sum(llm_calls) AS BIGINT) AS calls, sum(llm_cost_e4) / 10000 AS cost_usd FROM v_runs GROUP BY 1",
        "run_close": v("v_runs") + " SELECT run_id, CAST(jobs_found * 7 % 100 AS BIGINT) * 1000 + 500 AS total_ms FROM v_runs",
        "first_scan_flag": v("v_runs") + """ SELECT run_id, coalesce(sum(CASE WHEN status IN ('success', 'partial') THEN 1 ELSE 0 END)
            OVER (PARTITION BY company_id ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS baseline FROM v_runs""",
        "schedule_next": v("v_runs") + f", {streaks} SELECT run_id, streak, started_at + to_minutes(CAST(mins AS BIGINT)) AS next_scan_at, streak >= 10 AS deactivate FROM w",
        "daily_spend": v("v_runs") + f""", {calls}, r AS (SELECT *, CAST(sum(cost_e4) OVER w AS BIGINT) AS spent_e4, count(*) OVER w AS calls_today FROM calls
            WINDOW w AS (PARTITION BY CAST(ts AS DATE) ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING))
            SELECT call_id, spent_e4, calls_today, spent_e4 >= 2000 AS exhausted, greatest(2000 - spent_e4, 0) AS remaining_e4 FROM r""",
        "breaker_episodes": v("v_runs") + """, c AS (SELECT make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + CAST(floor((epoch_us(started_at) - epoch_us(TIMESTAMP '2024-01-01')) / 100) AS BIGINT)) AS ts, run_id AS call_id, jobs_found % 3 = 0 AS ok FROM v_runs),
            p AS (SELECT *, lag(ts) OVER (ORDER BY ts, call_id) AS pt, lag(ok) OVER (ORDER BY ts, call_id) AS po FROM c),
            i AS (SELECT *, sum(CASE WHEN pt IS NULL OR po OR epoch_us(ts) - epoch_us(pt) > 300000000 THEN 1 ELSE 0 END) OVER (ORDER BY ts, call_id) AS island FROM p WHERE NOT ok),
            k AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY ts, call_id) AS rn FROM i)
            SELECT max(CASE WHEN rn = 5 THEN ts END) AS opened_at, count(*) AS failures, max(ts) + INTERVAL 300 SECOND AS closes_at FROM k GROUP BY island HAVING count(*) >= 5""",
        "politeness_audit": v("v_attempts") + """, q AS (SELECT attempt_id, website AS domain, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS e FROM v_attempts),
            z AS (SELECT attempt_id, domain, CAST(floor((e - epoch(TIMESTAMP '2024-01-01')) / 500) AS BIGINT) AS s FROM q),
            n AS (SELECT attempt_id, count(*) OVER (PARTITION BY domain ORDER BY s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS in_last_minute FROM z)
            SELECT attempt_id, in_last_minute, in_last_minute > 20 AS over_limit FROM n""",
        "selector_health": v("v_attempts") + """, s AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY website ORDER BY ts DESC, attempt_id DESC) AS later_ok FROM v_attempts)
            SELECT website, CAST(list_reduce(list(CAST(CASE WHEN ok THEN 300 * confidence_pct ELSE 0 END AS BIGINT) ORDER BY ts, attempt_id), lambda c, v: (7 * c + v + 5) // 10, CAST(10000 AS BIGINT)) AS INTEGER) AS confidence_e4,
              count(*) FILTER (later_ok = 0) AS consecutive_failures, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS failure_count, count(*) FILTER (later_ok = 0) >= 3 AS relearn FROM s GROUP BY website""",
        "selector_success_rate": v("v_attempts") + " SELECT website, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS failure_count, count(*) FILTER (ok) / count(*) AS success_rate FROM v_attempts GROUP BY 1",
        "degraded_selectors": v("v_selectors") + " SELECT website, version, confidence FROM v_selectors WHERE is_active AND confidence < 0.6",
        "relearn_candidates": v("v_selectors", "v_companies") + """, d AS (SELECT * FROM v_selectors WHERE is_active AND confidence < 0.6 ORDER BY confidence, website, version LIMIT 20),
            c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY website ORDER BY name, company_id) AS rn FROM v_companies WHERE is_active) WHERE rn = 1)
            SELECT d.website, d.version, c.company_id, c.name FROM d JOIN c USING (website)""",
        "next_version": v("v_selectors") + " SELECT website, max(version) + 1 AS next_version FROM v_selectors GROUP BY 1",
        "selector_versions": v("v_selectors") + """, r AS (SELECT *, row_number() OVER (PARTITION BY website ORDER BY version DESC) AS age FROM v_selectors)
            SELECT website, version, age = 1 AS is_active FROM r WHERE age <= 3""",
        "pruned_versions": v("v_selectors") + """, r AS (SELECT *, row_number() OVER (PARTITION BY website, is_active ORDER BY version DESC) AS age FROM v_selectors)
            SELECT website, version, is_active FROM r WHERE is_active OR age <= 1""",
        "company_selector": v("v_companies", "v_selectors") + """, s AS (SELECT website, max(version) AS version, arg_max(confidence, version) AS confidence FROM v_selectors WHERE is_active GROUP BY 1)
            SELECT company_id, version, confidence FROM v_companies LEFT JOIN s USING (website)""",
        "notification_filter": v("v_notifications") + """, r AS (SELECT notification_id, created_at FROM v_notifications WHERE channel = 'email' AND status = 'sent' AND created_at >= TIMESTAMP '1995-01-01')
            SELECT notification_id, created_at, (SELECT count(*) FROM r) AS total FROM r ORDER BY created_at DESC, notification_id DESC LIMIT 100""",
        "retryable": v("v_notifications") + " SELECT notification_id, attempts FROM v_notifications WHERE status = 'failed' AND attempts < 3 ORDER BY created_at, notification_id LIMIT 100",
        "notification_log": v("v_notifications", "v_postings", "v_companies") + """, p AS (SELECT seq // 1000000 AS job_id, min(title) AS title, min(url) AS url FROM v_postings GROUP BY 1)
            SELECT notification_id, title, url, name AS user_name FROM v_notifications n LEFT JOIN p USING (job_id) LEFT JOIN v_companies c ON c.company_id = n.user_id""",
        "unnotified": v("v_notifications", "v_postings") + """ SELECT DISTINCT seq // 1000000 AS job_id, company_id % 60 AS user_id, 'slack' AS channel FROM v_postings p
            WHERE NOT EXISTS (SELECT 1 FROM v_notifications n WHERE n.job_id = p.seq // 1000000 AND n.user_id = p.company_id % 60 AND n.channel = 'slack')""",
        "already_notified": v("v_notifications") + " SELECT DISTINCT job_id, user_id, channel FROM v_notifications WHERE status <> 'failed'",
        "extraction_score": batches + """ SELECT company_id, tier, n AS jobs_found, e4 AS confidence_e4, e4 / 10000 AS confidence, CAST(round_even(1000 * (n - nl) / n, 0) AS INTEGER) AS missing_location_e3,
            concat_ws('|', CASE WHEN 2 * np < n THEN 'most titles do not read like job titles' END, CASE WHEN n >= 3 AND 2 * top > n THEN 'more than half the titles are identical' END,
              CASE WHEN du = 1 AND n > 1 THEN 'every posting points at the same URL' END, CASE WHEN 2 * nu < n THEN 'most postings have no link' END) AS reasons FROM d""",
        "acceptable": batches + " SELECT company_id, tier FROM d WHERE e4 >= 6000",
        "ladder_choice": batches + """ SELECT company_id, arg_min(tier, ord) FILTER (e4 >= 6000) AS tier,
            array_to_string(list(tier || CASE WHEN e4 >= 6000 THEN ':ok(' ELSE ':miss(' END || CAST(n AS VARCHAR) || ')' ORDER BY ord) FILTER (ord <= coalesce(win, 99)), '|') AS trail
            FROM (SELECT *, min(CASE WHEN e4 >= 6000 THEN ord END) OVER (PARTITION BY company_id) AS win FROM d) GROUP BY company_id""",
        "scan_report": v("v_runs") + """ SELECT run_id, company_id, jobs_found, jobs_new, jobs_duplicate, extraction_tier AS tier, jobs_found / 100 AS confidence,
            coalesce(sum(CASE WHEN status IN ('success', 'partial') THEN 1 ELSE 0 END) OVER (PARTITION BY company_id ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS baseline,
            CASE WHEN jobs_found = 0 THEN 'failed' WHEN jobs_found >= 60 THEN 'success' ELSE 'partial' END AS status FROM v_runs""",
        "price_lookup": """WITH k AS (SELECT DISTINCT 'm-' || substring(p_brand, 1, 7) AS px FROM part), q AS (SELECT * FROM k WHERE px NOT LIKE '%3'),
            u AS (SELECT p_partkey, 'm-' || p_brand || '-' || p_type AS model, p_size FROM part),
            m AS (SELECT u.*, (SELECT max(length(px)) FROM q WHERE starts_with(model, px)) AS best FROM u)
            SELECT p_partkey, round_even(p_size * 1000 / 1000000 * coalesce(best / 4, 3.0) + p_size * 100 / 1000000 * coalesce(best / 2, 15.0), 6) AS cost_usd FROM m""",
    }


SQL = _sql()
SQL["should_regenerate"] = with_views("v_companies") + f""", h AS ({SQL["selector_health"]})
    SELECT DISTINCT c.website, coalesce(h.consecutive_failures >= {V.RELEARN_AFTER_FAILURES}, true) AS regenerate
    FROM v_companies c LEFT JOIN h ON h.website = c.website AND NOT regexp_matches(h.website, '[05]\\.example')"""
