"""Posting dates: relative phrases, epochs, written dates, ages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlens.functions import fixed_values as V
from postlens.functions.text import bind, blank_to_null

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH_NAME = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    r"sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])\.?"
)
_ISO = r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_NUMERIC = r"(?<!\d)(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)"
_MONTH_DAY = rf"\b{_MONTH_NAME}\s*(\d{{1,2}})(?:st|nd|rd|th)?(?!\d|:)(?:,?\s*(\d{{4}}))?"
_DAY_MONTH = rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?[\s-]*(?:of\s+)?{_MONTH_NAME}(?:,?[\s-]*(\d{{4}}))?"
_MONTH_YEAR = rf"\b{_MONTH_NAME},?\s*(\d{{4}})"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(\.\d{1,6})?)?\d*\s*([ap]m)?\s*(z|utc|gmt|[+-]\d{2}:?\d{2})?"


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, month, day).try_cast("date")


def _month_number(name: Column) -> Column:
    at = F.instr(F.lit(_MONTHS), F.substring(name, 1, 3))
    return F.floor((at + 2) / 3).cast("string")


def _written_date(text: Column, fallback: Column, need_year: bool = False) -> Column:
    """First date shape found in lower-case text; missing parts come from ``fallback``."""

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    def year_of(pattern: str, group: int) -> Column:
        found = blank_to_null(part(pattern, group))
        return found if need_year else F.coalesce(found, F.year(fallback).cast("string"))

    def named(pattern: str, month: int, day: int, year: int) -> Column:
        return F.when(
            part(pattern, month) != "",
            _date(year_of(pattern, year), _month_number(part(pattern, month)), part(pattern, day)),
        )

    first, second, short = part(_NUMERIC, 1), part(_NUMERIC, 2), part(_NUMERIC, 3)
    full_year = F.when(F.length(short) == 2, F.concat(F.lit("20"), short)).otherwise(short)
    day_first = first.try_cast("int") > 12
    month_start = _date(
        part(_MONTH_YEAR, 2), _month_number(part(_MONTH_YEAR, 1)), F.lit("1")
    )
    same_day = F.least(F.day(fallback), F.day(F.last_day(month_start)))
    candidates = [
        _date(part(_ISO, 1), part(_ISO, 2), part(_ISO, 3)),
        _date(part(_COMPACT, 1), part(_COMPACT, 2), part(_COMPACT, 3)),
        F.when(
            first != "",
            F.when(day_first, _date(full_year, second, first)).otherwise(
                _date(full_year, first, second)
            ),
        ),
        named(_DAY_MONTH, 2, 1, 3),
        named(_MONTH_DAY, 1, 2, 3),
        F.when(part(_MONTH_YEAR, 1) != "", F.date_add(month_start, same_day - 1)),
    ]
    return F.coalesce(*candidates)


def _epoch_seconds(text: Column) -> Column:
    """Seconds for an all-digit value of at least nine digits, else null."""
    number = F.when(
        text.rlike(rf"^\d{{{V.EPOCH_MIN_DIGITS},}}$"), text.try_cast("decimal(38,3)")
    )
    seconds = F.when(number >= V.EPOCH_MILLIS_FROM, number / 1000).otherwise(number)
    return F.when(seconds < 253_402_300_800, seconds.cast("double"))


def parse_posted_date(value: Column, today: Column) -> Column:
    """Calendar date of a posting.  ``today`` is the capture date of the row.

    A written date in the future is last year's; one older than five calendar
    years is noise.  Only the date shapes above are read; anything else is null.
    """

    def parse(text: Column) -> Column:
        lowered = F.lower(F.trim(F.regexp_replace(text, V.POSTED_PREFIX, "")))

        def from_words(words: Column) -> Column:
            count = F.regexp_extract(words, V.RELATIVE_AGE, 1).try_cast("double")
            unit = F.regexp_extract(words, V.RELATIVE_AGE, 2)
            per_unit = F.coalesce(
                *[F.when(unit == u, F.lit(d)) for u, d in V.UNIT_DAYS.items()]
            )
            days_back = F.rint(count * per_unit).try_cast("int")
            return (
                F.when(words.isin(*V.TODAY_WORDS), today)
                .when(words == "yesterday", F.date_sub(today, 1))
                .when(count.isNotNull(), F.date_sub(today, days_back))
                .when(words.rlike(V.WITHIN_LAST), today)
                .otherwise(bind(_written_date(words, today), _settle))
            )

        def _settle(found: Column) -> Column:
            rolled = F.add_months(found, -12)
            rolled_ok = (rolled <= today) & (F.day(rolled) == F.day(found))
            return (
                F.when(found > today, F.when(rolled_ok, rolled))
                .when(F.year(found) >= F.year(today) - V.MAX_AGE_YEARS, found)
            )

        epoch = F.to_date(F.timestamp_seconds(_epoch_seconds(text)))
        return F.when(text == "", None).otherwise(F.coalesce(epoch, bind(lowered, from_words)))

    return bind(F.btrim(value, F.lit(" \t\r\n")), parse)


def _stamp(day: Column, clock: Column) -> Column:
    """ISO text of a day and the six groups of ``_CLOCK``."""

    def part(group: int) -> Column:
        return F.get(clock, F.lit(group - 1))

    hour = part(1).try_cast("int")
    hour = (
        F.when(part(5) == "pm", F.when(hour < 12, hour + 12).otherwise(hour))
        .when(part(5) == "am", F.when(hour == 12, 0).otherwise(hour))
        .otherwise(hour)
    )
    zone = F.regexp_replace(part(6), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    zone = F.when(zone.rlike(r"^[+-]"), zone).otherwise("Z")
    return F.concat(
        day, F.lit("T"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(2),
        F.lit(":"), F.when(part(3) == "", "00").otherwise(part(3)), part(4), zone,
    )


def parse_posted_datetime(value: Column, now: Column) -> Column:
    """Timestamp when the source carried a clock time, else null; never the future."""

    def parse(text: Column) -> Column:
        groups = "\x01".join(f"${n}" for n in range(1, 7))
        clock = F.split(F.regexp_replace(F.regexp_extract(text, _CLOCK, 0), _CLOCK, groups), "\x01")
        spaced = F.regexp_replace(text, r"(\d)t(\d{1,2}:)", "$1 $2")
        day = bind(spaced, lambda t: _written_date(t, F.to_date(now), True).cast("string"))
        stamp = bind(clock, lambda parts: _stamp(day, parts).try_cast("timestamp"))
        epoch = F.timestamp_seconds(_epoch_seconds(text))
        return F.coalesce(
            epoch, F.when(text.rlike(r"\d{1,2}:\d{2}"), bind(stamp, lambda s: F.when(s <= now, s)))
        )

    return bind(F.lower(F.btrim(value, F.lit(" \t\r\n"))), parse)


def days_since(day: Column, today: Column) -> Column:
    return F.date_diff(today, day)


def humanize_age(moment: Column, day: Column, now: Column) -> Column:
    """How a person would state the age of a posting."""

    def count(n: Column, unit: str) -> Column:
        return F.when(n == 1, f"1 {unit} ago").otherwise(
            F.concat(n.cast("string"), F.lit(f" {unit}s ago"))
        )

    seconds = (F.unix_micros(now) - F.unix_micros(moment)) / 1_000_000
    minutes = F.floor(seconds / 60)
    hours = F.floor(seconds / 3600)
    days = F.date_diff(F.to_date(now), F.coalesce(F.to_date(moment), day))
    return (
        F.when(seconds < 120, "just now")
        .when(seconds < 3600, F.concat(minutes.cast("string"), F.lit(" minutes ago")))
        .when(seconds < 86_400, count(hours, "hour"))
        .when(days.isNull(), "—")
        .when(days < 0, "just now")
        .when(days == 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 30, count(F.floor(days / 7), "week"))
        .otherwise(count(F.floor(days / 30), "month"))
    )
