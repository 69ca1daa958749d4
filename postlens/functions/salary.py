"""Salary columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlens.functions import fixed_values as V
from postlens.functions.text import bind, blank_to_null, word_list


def currency(text: Column) -> Column:
    """First listed code present as a word, else a symbol, two-character ones first."""
    found = F.regexp_extract_all(
        F.upper(text), F.lit(r"(?U)\b(" + "|".join(V.CURRENCY_CODES) + r")\b"), F.lit(1)
    )
    listed = word_list(V.CURRENCY_CODES)
    by_symbol = F.coalesce(
        *[F.when(F.contains(text, F.lit(s)), F.lit(code)) for s, code in V.CURRENCY_SYMBOLS]
    )
    return F.coalesce(F.get(F.array_intersect(listed, found), F.lit(0)), by_symbol)


def period(text: Column) -> Column:
    stated = [F.when(text.rlike("(?iU)" + p), F.lit(name)) for name, p in V.SALARY_PERIODS]
    return F.coalesce(*stated, F.lit("unknown"))


def _amount(token: Column) -> Column:
    """Token such as ``120,000`` or ``45k`` to a whole number; null if implausible.

    Three digits after the last separator mean thousands; then every separator
    goes, also a decimal point.
    """
    number = F.regexp_replace(token, r"\s*[kKmM]?$", "")
    grouped = number.rlike(r"[.,\s]\d{3}(?:\D|$)")
    plain = F.when(grouped, F.regexp_replace(number, r"[.,\s]", "")).otherwise(
        F.replace(F.replace(number, F.lit(","), F.lit(".")), F.lit(" "), F.lit(""))
    )
    scale = F.when(token.rlike("[kK]$"), 1_000.0).when(token.rlike("[mM]$"), 1_000_000.0).otherwise(1.0)
    value = plain.try_cast("double") * scale
    return F.when((value > 0) & (value <= V.MAX_AMOUNT), F.rint(value).cast("int"))


def parse_salary(text: Column) -> Column:
    """``struct(raw, minimum, maximum, currency, period)`` of a ``clean_text`` column."""
    raw = F.coalesce(text, F.lit(""))

    def result(low: Column, high: Column, unit: Column) -> Column:
        return F.struct(
            blank_to_null(raw).alias("raw"),
            low.cast("int").alias("minimum"),
            high.cast("int").alias("maximum"),
            currency(raw).alias("currency"),
            unit.alias("period"),
        )

    def settle(amounts: Column) -> Column:
        first, second = F.get(amounts, F.lit(0)), F.get(amounts, F.lit(1))
        low = F.least(first, second)
        high = F.when(second.isNotNull(), F.greatest(first, second))
        stated = period(raw)
        unit = F.when((stated == "unknown") & (low >= V.MIN_IMPLIED_YEARLY), "year").otherwise(stated)

        def checked(u: Column) -> Column:
            absurd = F.coalesce((u == "year") & (low < V.MIN_YEARLY_AMOUNT), F.lit(False))
            return result(
                F.when(~absurd, low), F.when(~absurd, high), F.when(absurd, "unknown").otherwise(u)
            )

        return bind(unit, checked)

    tokens = F.regexp_extract_all(raw, F.lit(V.SALARY_AMOUNT), F.lit(1))
    amounts = F.slice(F.filter(F.transform(tokens, _amount), lambda a: a.isNotNull()), 1, 2)
    empty = result(F.lit(None), F.lit(None), F.lit("unknown"))
    return F.when(raw == "", empty).otherwise(bind(amounts, settle))


def to_annual(minimum: Column, unit: Column) -> Column:
    """Lower bound as a full-time yearly figure; null for an unknown period."""
    factor = F.coalesce(*[F.when(unit == u, F.lit(n)) for u, n in V.PERIODS_PER_YEAR.items()])
    return minimum.cast("bigint") * factor
