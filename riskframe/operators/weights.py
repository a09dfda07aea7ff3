"""Sample weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def frequency_weights(df: DataFrame, company: str) -> DataFrame:
    """Inverse company frequency ``1/n`` and its scaled form ``mean(n)/n``.

    Counted by a grouped aggregation joined back, not by a window: a company holding a third
    of the rows is counted map-side and its rows stay where they are (the planner may split
    or broadcast the join by the measured size of the counts).
    """
    sizes = df.groupBy(company).agg(F.count(F.lit(1)).alias("__n"))
    mean_n = sizes.agg((F.sum("__n") / F.count(F.lit(1))).alias("__mean"))
    joined = df.join(sizes, company, "left").crossJoin(F.broadcast(mean_n))  # exactly one row
    return joined.select(*df.columns, (F.lit(1.0) / F.col("__n")).alias("w_inverse"),
                         (F.col("__mean") / F.col("__n")).alias("w_mean"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: ``n / (2 n_c)`` and ``1000 / n_c``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("__total")))
    return counts.crossJoin(total).select(label, "n", (F.col("__total") / (2.0 * F.col("n"))).alias("w_balanced"),
                                          (1000.0 / F.col("n")).alias("w_thousand"))


def time_decay(ts: str, latest: Column, half_life_days: float) -> Column:
    """Weight 1 at ``latest``, halved every ``half_life_days``."""
    return F.exp(-F.lit(math.log(2.0)) * F.datediff(latest, F.col(ts)) / F.lit(half_life_days))


def scaled_weights(df: DataFrame, frequency: str, amount: str, ts: str, half_life_days: float = 180.0,
                   out: str = "w_scaled") -> DataFrame:
    """min-max(frequency weight + min-max(amount)) x time decay, normalised to sum to n.

    Three small aggregations give the bounds, each broadcast as one row.
    """
    a = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    first = df.agg(F.min(a).alias("__lo"), F.max(a).alias("__hi"), F.max(ts).alias("__last"))
    mixed = df.crossJoin(F.broadcast(first)).withColumn(
        "__w", F.col(frequency) + F.coalesce(F.try_divide(a - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0)))
    second = mixed.agg(F.min("__w").alias("__wlo"), F.max("__w").alias("__whi"))
    raw = mixed.crossJoin(F.broadcast(second)).withColumn(
        "__r", F.coalesce(F.try_divide(F.col("__w") - F.col("__wlo"), F.col("__whi") - F.col("__wlo")), F.lit(0.0))
        * time_decay(ts, F.col("__last"), half_life_days))
    total = raw.agg(F.sum("__r").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    return raw.crossJoin(F.broadcast(total)).select(*df.columns, F.try_divide(F.col("__r") * F.col("__n"), F.col("__sum")).alias(out))


