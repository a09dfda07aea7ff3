"""Capture curves, knees and lift tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage
from .chunks import CHUNKS, attach_totals, ntiles, running


def capture_curve(df: DataFrame, x: str, weight: Column | None = None, keys: list[str] | None = None,
                  n_chunks: int | None = CHUNKS) -> DataFrame:
    """Cumulative share of ``weight`` (default: rows) by increasing ``x``, one row per distinct x."""
    keys = keys or []
    per_x = cut_lineage(df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(
        F.sum(weight if weight is not None else F.lit(1)).cast("double").alias("amount")))
    cum = running(per_x, keys, [x], {"cumulative": ("sum", F.col("amount"))}, n_chunks=n_chunks)
    total = attach_totals(cum, keys, per_x.groupBy(*keys).agg(F.sum("amount").alias("__total")))
    return total.select(*keys, x, "amount", "cumulative", F.try_divide("cumulative", "__total").alias("share"))


def knee_point(curve: DataFrame, x: str, y: str, keys: list[str] | None = None, sensitivity: float = 1.0,
               n_chunks: int | None = CHUNKS) -> DataFrame:
    """Knee of a concave increasing curve.

    With both axes scaled to [0, 1] and d = y - x, every local maximum of d sets a threshold,
    its d less ``sensitivity`` times the mean x step; a local minimum resets it to 0. The knee
    is the maximum in force at the first row whose d falls below the threshold. Neighbours and
    thresholds come from chunked scans, so a curve of any length works.
    """
    keys = keys or []
    cx = F.col(x).cast("double")
    ends = curve.groupBy(*keys).agg(F.min(cx).alias("__x0"), F.max(cx).alias("__x1"), F.min(y).alias("__y0"),
                                    F.max(y).alias("__y1"), F.count(F.lit(1)).alias("__n"))
    sized = attach_totals(curve.select(*keys, x, y), keys, ends)
    unit = lambda c, lo, hi: F.try_divide(c - F.col(lo), F.col(hi) - F.col(lo))
    d = sized.select(*keys, F.col(x), "__n", cx.alias("__asc"), (-cx).alias("__desc"),
                     (unit(F.col(y), "__y0", "__y1") - unit(cx, "__x0", "__x1")).alias("__d"))
    d = running(d, keys, ["__asc"], {"__l": ("last", F.col("__d"))}, inclusive=False, n_chunks=n_chunks)
    d = running(d, keys, ["__desc"], {"__r": ("last", F.col("__d"))}, inclusive=False, n_chunks=n_chunks)
    left, right = F.coalesce("__l", "__d"), F.coalesce("__r", "__d")
    is_max = (F.col("__d") >= left) & (F.col("__d") >= right)
    is_min = (F.col("__d") <= left) & (F.col("__d") <= right)
    step = F.lit(sensitivity) / (F.col("__n") - 1)
    d = running(d, keys, ["__asc"], {
        "__thr": ("last", F.when(is_min, F.lit(0.0)).when(is_max, F.col("__d") - step)),
        "__peak": ("last", F.when(is_max, F.col(x)))}, inclusive=False, n_chunks=n_chunks)
    fallen = d.where((F.col("__d") < F.col("__thr")) & F.col("__peak").isNotNull())
    return fallen.groupBy(*keys).agg(F.min_by("__peak", x).alias("knee"))


def lift_table(df: DataFrame, score: str, label: str, row_id: str, n: int = 10, n_chunks: int | None = CHUNKS) -> DataFrame:
    """Deciles of the score (highest first): size, positives, rate, cumulative capture, lift."""
    keyed = df.select(row_id, F.col(label).cast("double").alias("__y"), (-F.col(score)).alias("__neg"), score)
    tiles = ntiles(keyed, [], ["__neg", row_id], n, "decile", n_chunks=n_chunks)
    per = tiles.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("positives"),
                                      F.min(score).alias("min_score"), F.max(score).alias("max_score"))
    # n rows from here on
    all_rows = W.partitionBy(F.lit(0))
    total_p, total_n = F.sum("positives").over(all_rows), F.sum("n").over(all_rows)
    rate = F.col("positives") / F.col("n")
    return per.select(
        "decile", "n", F.col("positives").cast("long").alias("positives"), "min_score", "max_score", rate.alias("rate"),
        F.try_divide(F.sum("positives").over(all_rows.orderBy("decile").rowsBetween(W.unboundedPreceding, 0)), total_p)
        .alias("cumulative_capture"), F.try_divide(rate, total_p / total_n).alias("lift"))
