"""Longest-prefix price lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlens.functions import fixed_values as V


def price_lookup(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per usage row at the price of the longest listed prefix of its model.

    ``usage(model, tokens_in, tokens_out)``, ``prices(model_prefix, price_in,
    price_out)`` in USD per million tokens.  Only the distinct model names are
    matched: each gives its prefixes, which meet the list by an equi join.
    """
    models = usage.select("model").distinct()
    prefixes = models.select(
        "model",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("model"), F.lit(1))),
            lambda i: F.substring(F.col("model"), F.lit(1), i),
        )).alias("model_prefix"),
    )
    best = (
        prefixes.join(prices, "model_prefix").groupBy("model")
        .agg(F.max_by(F.struct("price_in", "price_out"), F.length("model_prefix")).alias("price"))
    )
    priced = usage.join(best, "model", "left")
    price_in = F.coalesce(F.col("price.price_in"), F.lit(V.DEFAULT_PRICE_IN))
    price_out = F.coalesce(F.col("price.price_out"), F.lit(V.DEFAULT_PRICE_OUT))
    cost = F.col("tokens_in") / 1_000_000 * price_in + F.col("tokens_out") / 1_000_000 * price_out
    return priced.withColumn("cost_usd", F.bround(cost, 6)).drop("price")
