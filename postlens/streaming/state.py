"""Keyed state: posting lifetimes and selector health.

Selector health needs the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass`` (see :func:`use_rocksdb`).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

# The processors travel with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def last_seen_state(sightings: DataFrame, days: int = 7, lateness: str = "1 day") -> DataFrame:
    """``sightings(company_id, content_hash, fetched_at)`` to postings closed after ``days`` unseen.

    A session window per posting is exactly this state: it grows with every sighting
    and is emitted, with first and last time, once the watermark passes its end.  A
    posting that comes back later opens a new one.
    """
    quiet = F.session_window("fetched_at", f"{days} days")
    return (
        sightings.select("company_id", "content_hash", "fetched_at")
        .withWatermark("fetched_at", lateness)
        .groupBy("company_id", "content_hash", quiet)
        .agg(F.min("fetched_at").alias("first_seen_at"), F.max("fetched_at").alias("last_seen_at"))
        .drop("session_window")
    )


HEALTH = _schema(
    website=T.StringType(), confidence_e4=T.IntegerType(), consecutive_failures=T.LongType(),
    success_count=T.LongType(), failure_count=T.LongType(), relearn=T.BooleanType(),
)


class SelectorHealth(StatefulProcessor):
    """Moving confidence and failure streak per website, one row per batch."""

    def __init__(self, relearn_after: int, initial_e4: int) -> None:
        self.relearn_after, self.initial_e4 = relearn_after, initial_e4

    def init(self, handle) -> None:
        self.health = handle.getValueState("health", _schema(
            c=T.IntegerType(), streak=T.LongType(), ok=T.LongType(), bad=T.LongType()
        ))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c, streak, good, bad = self.health.get() if self.health.exists() else (self.initial_e4, 0, 0, 0)
        # One website's attempts of one micro-batch, which the source rate bounds.
        batch = pd.concat(list(rows)).sort_values(["ts", "attempt_id"])
        for ok, x in zip(batch["ok"], batch["confidence_e4"]):
            c = (7 * c + (3 * int(x) if ok else 0) + 5) // 10
            streak, good, bad = (0, good + 1, bad) if ok else (streak + 1, good, bad + 1)
        self.health.update((int(c), int(streak), int(good), int(bad)))
        yield pd.DataFrame({
            "website": [key[0]], "confidence_e4": [c], "consecutive_failures": [streak],
            "success_count": [good], "failure_count": [bad], "relearn": [streak >= self.relearn_after],
        })

    def close(self) -> None:
        pass


def selector_health_stream(
    attempts: DataFrame, relearn_after: int = 3, initial_e4: int = 10_000
) -> DataFrame:
    """``attempts(website, ts, attempt_id, ok, confidence_e4)``, in order across batches."""
    return (
        attempts.select("website", "ts", "attempt_id", "ok", F.col("confidence_e4").cast("int").alias("confidence_e4"))
        .groupBy("website")
        .transformWithStateInPandas(SelectorHealth(relearn_after, initial_e4), HEALTH, "update", "None")
    )
