"""Notifications: listing, retry, claims, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlens.functions import fixed_values as V
from postlens.functions.labels import escape_markup, humanise, score_percent

MAIL_STRONG = 0.75      # from this score on a match is shown as a strong one
CLAIM = ("job_id", "user_id", "channel")


def notification_filter(
    notifications: DataFrame, user_id: int | None = None, channel: str | None = None,
    status: str | None = None, since: Column | None = None,
) -> DataFrame:
    out = notifications
    for name, value in (("user_id", user_id), ("channel", channel), ("status", status)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out if since is None else out.filter(F.col("created_at") >= since)


NEWEST_FIRST = ("created_at", "notification_id")


def newest_first() -> list[Column]:
    return [F.col(c).desc() for c in NEWEST_FIRST]


def retryable(
    notifications: DataFrame, max_attempts: int = V.RETRY_ATTEMPTS, limit: int | None = None
) -> DataFrame:
    failed = notifications.filter((F.col("status") == "failed") & (F.col("attempts") < max_attempts))
    ordered = failed.orderBy("created_at", "notification_id")
    return ordered if limit is None else ordered.limit(limit)


def notification_log(notifications: DataFrame, postings: DataFrame, users: DataFrame) -> DataFrame:
    """Notification with posting title and link, and the user."""
    return (
        notifications.join(postings.select("job_id", "title", "url"), "job_id", "left")
        .join(users.select("user_id", "user_name"), "user_id", "left")
    )


def unnotified(candidates: DataFrame, notifications: DataFrame) -> DataFrame:
    """Claims (job, user, channel) without any row, also no failed one; each once."""
    return (
        candidates.dropDuplicates(list(CLAIM))
        .join(notifications.select(*CLAIM), list(CLAIM), "left_anti")
    )


def already_notified(notifications: DataFrame) -> DataFrame:
    """Claims delivered or in flight."""
    return notifications.filter(F.col("status") != "failed").select(*CLAIM).distinct()


def _short(value: Column, limit: int) -> Column:
    cut = F.concat(F.substring(value, 1, limit - 1), F.lit("…"))
    return F.when(F.length(value) > limit, cut).otherwise(value)


def _lines(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.flatten(F.array(*parts))), "\n")


def _line(*texts) -> Column:
    return F.array(F.concat(*[F.lit(t) if isinstance(t, str) else t for t in texts]))


def _given(value: Column, *texts) -> Column:
    return F.when(value.isNotNull() & (value != ""), _line(*texts)).otherwise(
        F.array().cast("array<string>")
    )


def mail_html(rows: DataFrame) -> Column:
    """The HTML part of a mail; all values are escaped, empty parts are left out."""
    c = F.col

    def fact(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"<tr><th>{label}</th><td>"), escape_markup(value), F.lit("</td></tr>"))

    def skills(label: str, name: str, limit: int) -> Column:
        if name not in rows.columns:
            return F.lit(None).cast("string")
        listed = escape_markup(F.array_join(F.slice(name, 1, limit), ", "))
        return F.when(F.size(name) > 0, F.concat(F.lit(f"<p><b>{label}</b> "), listed, F.lit("</p>")))

    colour = F.when(c("score") >= MAIL_STRONG, "#1b5e20").otherwise("#8d6e00")
    facts = F.array_join(F.array_compact(F.array(
        fact("Location", c("location")), fact("Type", humanise(c("employment_type"))),
        fact("Remote", humanise(c("remote_type"))),
        F.when(c("salary") != "", fact("Salary", c("salary"))),
        fact("Posted", c("posted_date").cast("string")),
    )), "")
    return F.array_join(F.array_compact(F.array(
        F.lit('<!doctype html><html><head><meta charset="utf-8"></head><body style="font-family:sans-serif">'),
        F.concat(F.lit("<h1>"), escape_markup(c("job_title")), F.lit("</h1>")),
        F.concat(F.lit("<h2>"), escape_markup(c("company_name")), F.lit("</h2>")),
        F.concat(
            F.lit('<p style="color:'), colour, F.lit('">'), score_percent(c("score")).cast("string"), F.lit("% match</p>"),
        ),
        F.concat(F.lit("<table>"), facts, F.lit("</table>")),
        F.when(c("reasoning") != "", F.concat(
            F.lit("<h3>Why this matched</h3><p>"), escape_markup(c("reasoning")), F.lit("</p>"),
        )),
        skills("Your skills mentioned:", "matched_skills", 8), skills("Not mentioned:", "missing_skills", 6),
        F.concat(F.lit('<p><a href="'), escape_markup(c("url")), F.lit('">View &amp; apply</a></p>')),
        F.lit("</body></html>"),
    )), "\n")


def render(rows: DataFrame) -> DataFrame:
    """Subject, plain text, mail HTML, chat markup and message blocks per alert row.

    Input: ``job_title, company_name, location, employment_type, remote_type, salary,
    posted_date, reasoning, matched_skills, score, url``; empty parts are left out.
    ``missing_skills`` may be given, the HTML lists them.
    """
    c = F.col
    percent = F.concat(score_percent(c("score")).cast("string"), F.lit("%"))
    date = c("posted_date").cast("string")
    skills = F.when(F.size("matched_skills") > 0, F.array_join(F.slice("matched_skills", 1, 8), ", "))
    blank = F.array(F.lit(""))
    why = F.when(c("reasoning") != "", F.concat(blank, _line("Why this matched:"), _line(c("reasoning"))))
    none = F.array().cast("array<string>")
    text = _lines(
        _line(c("job_title"), " — ", c("company_name")), blank,
        _line("Match:    ", percent), _line("Location: ", c("location")),
        _line("Type:     ", humanise(c("employment_type"))),
        _line("Remote:   ", humanise(c("remote_type"))),
        _given(c("salary"), "Salary:   ", c("salary")), _given(date, "Posted:   ", date),
        F.coalesce(why, none),
        F.coalesce(F.when(skills.isNotNull(), F.concat(blank, _line("Your skills mentioned: ", skills))), none),
        blank, _line("Apply: ", c("url")),
    )
    reason = escape_markup(_short(c("reasoning"), 400))
    telegram = _lines(
        _line("<b>", escape_markup(c("job_title")), "</b>"), _line(escape_markup(c("company_name"))),
        blank, _line("📍 ", escape_markup(c("location"))), _line("🎯 ", percent, " match"),
        _given(c("salary"), "💰 ", escape_markup(c("salary"))), _given(date, "🗓 ", date),
        F.coalesce(F.when(c("reasoning") != "", F.concat(blank, _line("<i>", reason, "</i>"))), none),
        blank, _line('<a href="', escape_markup(c("url")), '">View &amp; apply</a>'),
    )

    def mark(*texts) -> Column:
        return F.struct(F.lit("mrkdwn").alias("type"), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in texts]).alias("text"))

    fields = F.array_compact(F.array(
        mark("*Location*\n", c("location")), mark("*Match*\n", percent),
        F.when(c("salary") != "", mark("*Salary*\n", c("salary"))),
        F.when(date.isNotNull(), mark("*Posted*\n", date)),
    ))
    header = F.to_json(F.struct(
        F.lit("header").alias("type"),
        F.struct(F.lit("plain_text").alias("type"), _short(c("job_title"), 150).alias("text")).alias("text"),
    ))
    section = F.to_json(F.struct(
        F.lit("section").alias("type"), mark("*", c("company_name"), "*").alias("text"), fields.alias("fields"),
    ))
    note = F.when(c("reasoning") != "", F.to_json(F.struct(
        F.lit("section").alias("type"), mark("_", _short(c("reasoning"), 500), "_").alias("text"),
    )))
    button = F.to_json(F.struct(
        F.lit("actions").alias("type"),
        F.array(F.struct(
            F.lit("button").alias("type"),
            F.struct(F.lit("plain_text").alias("type"), F.lit("View & apply").alias("text")).alias("text"),
            c("url").alias("url"), F.lit("primary").alias("style"),
        )).alias("elements"),
    ))
    blocks = F.concat(
        F.lit("["), F.array_join(F.array_compact(F.array(header, section, note, button)), ","), F.lit("]")
    )
    return rows.withColumns({
        "subject": F.concat(
            F.lit("["), percent, F.lit(" match] "), c("job_title"), F.lit(" — "), c("company_name")
        ),
        "text": text,
        "html": mail_html(rows),
        "telegram": telegram,
        "slack_text": F.concat(c("job_title"), F.lit(" at "), c("company_name")),
        "slack_blocks": blocks,
    })


def alerts(
    matches: DataFrame, runs: DataFrame, notifications: DataFrame, channels: list[str]
) -> DataFrame:
    """Messages to send: matched, not of a baseline scan, not yet claimed.

    ``matches`` has the columns of :func:`render` plus ``job_id, user_id, run_id,
    is_match``; ``runs(run_id, baseline)``.
    """
    live = matches.filter("is_match").join(
        runs.filter(~F.col("baseline")).select("run_id"), "run_id", "left_semi"
    )
    fanned = live.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    return render(unnotified(fanned, notifications))
