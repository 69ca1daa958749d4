"""Display labels, score cleaning, enum checks and JSON answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlens.functions import fixed_values as V
from postlens.functions.text import collapse_blanks
from postlens.functions.urls import title_case


def humanise(value: Column) -> Column:
    return title_case(F.replace(value, F.lit("_"), F.lit(" ")))


def score_percent(score: Column) -> Column:
    return F.floor(score * 100).cast("int")


def score_class(score: Column) -> Column:
    return F.when(score >= 0.75, "score").otherwise("score mid")


def escape_markup(value: Column) -> Column:
    for char, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
    ):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def enum_coerce(value: Column, allowed, name: str) -> Column:
    """Value for writing; an unknown one fails the job.  Reading needs no check."""
    message = F.concat(F.lit(f"{name}: "), value, F.lit(f" is not one of {', '.join(allowed)}"))
    return F.when(value.isNull() | value.isin(*allowed), value).otherwise(
        F.raise_error(message).cast("string")
    )


SENIORITY_LEVELS = tuple(V.SENIORITY_RANK)
REMOTE_PREFERENCES = ("remote_only", "hybrid_ok", "onsite_ok", "any")


def model_json(text: Column) -> Column:
    """JSON (VARIANT) of a free-text answer: fenced block, whole text, {...}, [...].

    Null when nothing parses.
    """
    trimmed = F.btrim(text, F.lit(" \t\r\n"))
    fenced = F.regexp_extract(trimmed, r"(?s)```(?:json)?\s*(.*?)```", 1)
    has_fence = trimmed.rlike(r"(?s)```(?:json)?\s*.*?```")
    body = F.when(has_fence, F.btrim(fenced, F.lit(" \t\r\n"))).otherwise(trimmed)
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    brackets = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    return F.coalesce(*[
        F.when(c != "", F.try_parse_json(c)) for c in (body, braces, brackets)
    ])


def as_score(value: Column) -> Column:
    """A supplied score as 0..1 with four decimals; answers on a 0..100 scale are divided."""
    number = F.coalesce(value.try_cast("double"), F.lit(0.0))
    scaled = F.when(number > 100, 1.0).when(number > 1, number / 100).otherwise(number)
    return F.bround(F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0)), 4)


def as_text_list(values: Column) -> Column:
    """Non-blank texts of an array, trimmed."""
    return F.filter(F.transform(values, lambda v: collapse_blanks(F.coalesce(v, F.lit("")))), lambda v: v != "")
