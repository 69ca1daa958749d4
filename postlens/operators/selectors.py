"""Selector versions and health."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from postlens.functions import fixed_values as V
from postlens.operators.common import first_per_key, ordered_slices, top_per_key


def active_selector(selectors: DataFrame) -> DataFrame:
    """Active selector of highest version per website."""
    return first_per_key(selectors.filter("is_active"), ["website"], [F.col("version").desc()])


def company_selector(companies: DataFrame, selectors: DataFrame) -> DataFrame:
    return companies.join(active_selector(selectors).drop("is_active"), "website", "left")


def degraded_selectors(selectors: DataFrame, threshold: float = V.MIN_CONFIDENCE) -> DataFrame:
    return (
        selectors.filter(F.col("is_active") & (F.col("confidence") < threshold))
        .orderBy("confidence", "website", "version")
    )


def relearn_candidates(
    selectors: DataFrame, companies: DataFrame, threshold: float = V.MIN_CONFIDENCE, limit: int | None = None
) -> DataFrame:
    """Worst degraded selectors, each with the first active company of its website."""
    worst = degraded_selectors(selectors, threshold)
    worst = worst if limit is None else worst.limit(limit)
    first = first_per_key(companies.filter("is_active"), ["website"], [F.col("name"), F.col("company_id")])
    return worst.join(first.select("website", "company_id", "name"), "website")


def next_version(selectors: DataFrame) -> DataFrame:
    return selectors.groupBy("website").agg(
        (F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version")
    )


def selector_versions(selectors: DataFrame, keep: int = V.KEEP_INACTIVE_VERSIONS) -> DataFrame:
    """Promote the newest version per website, retire the rest, keep the newest
    ``keep`` retired ones."""
    kept = top_per_key(selectors, ["website"], [F.col("version").desc()], keep + 1, rank="__age")
    return kept.withColumn("is_active", F.col("__age") == 1).drop("__age")


def pruned_versions(selectors: DataFrame, keep: int = V.KEEP_INACTIVE_VERSIONS) -> DataFrame:
    """Retention alone: all active versions plus the newest ``keep`` inactive ones."""
    inactive = top_per_key(
        selectors.filter(~F.col("is_active")), ["website"], [F.col("version").desc()], keep
    )
    return selectors.filter("is_active").unionByName(inactive)


def selector_success_rate(attempts: DataFrame) -> DataFrame:
    ok = F.count_if("ok")
    return attempts.groupBy("website").agg(
        ok.alias("success_count"), F.count_if(~F.col("ok")).alias("failure_count"),
        F.coalesce(F.try_divide(ok, F.count(F.lit(1))), F.lit(0.0)).alias("success_rate"),
    )


CONFIDENCE_STEPS = 10_001

# ``_compose`` travels with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _compose(steps: np.ndarray) -> tuple[list[int], list[int]]:
    """What a run of attempts does to every possible starting confidence.

    A step maps confidence c (in ten-thousandths) to (7c + v + 5) // 10, which is
    monotone, so the whole effect is a step function: ``starts`` and ``values``.
    """
    starts = np.arange(CONFIDENCE_STEPS)
    values = starts.copy()
    for i, v in enumerate(steps):
        values = (7 * values + v + 5) // 10
        if i % 4 == 3 or i == len(steps) - 1:
            first = np.concatenate(([True], values[1:] != values[:-1]))
            starts, values = starts[first], values[first]
    return starts.tolist(), values.tolist()


def selector_health(attempts: DataFrame, initial_e4: int = 10_000) -> DataFrame:
    """Confidence, streak and counters per website after all its attempts.

    ``attempts(website, ts, attempt_id, ok, confidence_e4)``.  The moving average
    c <- .7c + .3x (success) or .7c (failure) with rounding is order-dependent, so
    the attempts of one (website, slice of time) are composed into a step function in
    parallel, and only those small functions are applied in order per website.  Slices
    are bounded in rows, so a website with a third of all attempts is many of them.
    """
    schema = (
        "website string, slice int, starts array<int>, effects array<int>, "
        "n bigint, n_ok bigint, tail bigint, any_ok boolean"
    )

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "attempt_id"])
        ok = pdf["ok"].to_numpy(dtype=bool)
        starts, effects = _compose(np.where(ok, 3 * pdf["confidence_e4"].to_numpy(), 0))
        hits = np.flatnonzero(ok)
        tail = len(ok) - 1 - hits[-1] if len(hits) else len(ok)
        return pd.DataFrame([{
            "website": pdf["website"].iloc[0], "slice": pdf["slice"].iloc[0], "starts": starts,
            "effects": effects, "n": len(ok), "n_ok": int(ok.sum()), "tail": int(tail),
            "any_ok": bool(ok.any()),
        }])

    told = attempts.select("website", "ts", "attempt_id", "ok", F.col("confidence_e4").cast("int").alias("confidence_e4"))
    parts = ordered_slices(told, ["website", "ts", "attempt_id"]).groupBy("website", "slice").applyInPandas(summarise, schema)

    def apply_slice(state: Column, b: Column) -> Column:
        at = F.size(F.filter(b["starts"], lambda s: s <= state["c"])) - 1
        return F.struct(
            F.get(b["effects"], at).alias("c"),
            F.when(b["any_ok"], b["tail"]).otherwise(state["streak"] + b["tail"]).alias("streak"),
        )

    ordered = F.array_sort(F.collect_list(F.struct("slice", "starts", "effects", "tail", "any_ok")))
    folded = parts.groupBy("website").agg(
        F.aggregate(
            ordered,
            F.struct(F.lit(initial_e4).alias("c"), F.lit(0).cast("bigint").alias("streak")),
            apply_slice,
        ).alias("state"),
        F.sum("n_ok").alias("success_count"),
        (F.sum("n") - F.sum("n_ok")).alias("failure_count"),
    )
    return folded.select(
        "website", F.col("state.c").alias("confidence_e4"),
        F.col("state.streak").alias("consecutive_failures"), "success_count", "failure_count",
        (F.col("state.streak") >= V.RELEARN_AFTER_FAILURES).alias("relearn"),
    )
