"""Weight-of-evidence binning and information value."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pre-bins, smallest bin share, and the information-value bands (spelled as their readers expect).
PREBINS, MIN_BIN = 33, 0.033
POWER_BANDS = ((0.5, "suspecious"), (0.3, "strong"), (0.1, "medium"))
WEAK_FROM = 0.02


def power_band(iv: Column | str) -> Column:
    c = F.col(iv) if isinstance(iv, str) else iv
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for above, name in POWER_BANDS:
        out = out.when(c > above, name)
    return out.when(c >= WEAK_FROM, "weak").otherwise("useless")


def quantile_edges(df: DataFrame, columns: list[str], bins: int, accuracy: int = 10000) -> dict[str, list[float]]:
    """Distinct inner quantile edges of several columns from one pass of mergeable sketches.

    The driver receives at most (bins - 1) numbers per column.
    """
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(c) for c in columns]).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def bin_index(column: str, edges: list[float]) -> Column:
    """Number of edges at or below the value (bins closed on the left); null for missing."""
    c = F.col(column).cast("double")
    return F.when(c.isNotNull(), sum(((c >= float(e)).cast("int") for e in edges), F.lit(0)))


def bin_counts(df: DataFrame, columns: list[str], edges: dict[str, list[float]], y: str) -> DataFrame:
    """(feature, bin, n, events) of every column in one aggregation; missing values are bin -1."""
    long = df.select(F.col(y).cast("double").alias("__y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.coalesce(bin_index(c, edges[c]), F.lit(-1)).alias("bin")) for c in columns])).alias("r"))
    return long.groupBy("r.feature", "r.bin").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("events"))


def woe_column(n: Column, events: Column, total_n: Column, total_events: Column) -> Column:
    """ln((share of non-events) / (share of events)); 0 when either is empty."""
    non, bad = (n - events) / (total_n - total_events), events / total_events
    return F.when((non > 0) & (bad > 0), F.ln(non / bad)).otherwise(F.lit(0.0))


def information_value(df: DataFrame, columns: list[str], y: str, bins: int = 10, accuracy: int = 10000) -> DataFrame:
    """Information value and power band of each numeric column over quantile bins."""
    counts = bin_counts(df, columns, quantile_edges(df, columns, bins, accuracy), y)
    totals = counts.groupBy(F.col("feature").alias("__f")).agg(F.sum("n").alias("__n"), F.sum("events").alias("__e"))
    j = counts.join(F.broadcast(totals), F.col("feature") == F.col("__f"))  # one row per column
    n, e, tn, te = F.col("n"), F.col("events"), F.col("__n"), F.col("__e")
    term = ((n - e) / (tn - te) - e / te) * woe_column(n, e, tn, te)
    out = j.groupBy("feature").agg(F.sum(term).alias("iv"))
    return out.withColumn("power", power_band("iv"))


@dataclass
class WoeModel:
    """Bin edges and weights of one column; apply with plain comparisons."""

    column: str
    edges: list[float]
    weights: list[float]
    missing: float

    def expression(self) -> Column:
        c = F.col(self.column).cast("double")
        out = F.when(c.isNull(), F.lit(self.missing))
        for edge, w in zip(self.edges, self.weights):
            out = out.when(c < edge, F.lit(w))
        return out.otherwise(F.lit(self.weights[-1]))

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        return df.withColumn(out or f"{self.column.removesuffix('_encoded')}_encoded", self.expression())


def _pool(bins: list[list[float]], worse) -> list[list[float]]:
    """Merge neighbours [upper edge, n, events] until no pair breaks ``worse(left, right)``."""
    out: list[list[float]] = []
    for b in bins:
        out.append(list(b))
        while len(out) > 1 and worse(out[-2], out[-1]):
            right = out.pop()
            out[-1] = [right[0], out[-1][1] + right[1], out[-1][2] + right[2]]
    return out


def merge_bins(bins: list[list[float]], total: float, min_share: float = MIN_BIN) -> list[list[float]]:
    """Large enough, two-class, monotone bins from at most a few dozen pre-bins.

    The direction is the sign of the count-weighted trend of the event rate; violators are
    pooled. Works on pre-bin totals only (a few dozen rows on the driver).
    """
    small = min_share * total

    def thin(b):
        return b[1] < small or b[2] <= 0 or b[2] >= b[1]

    merged = _pool(bins, lambda a, b: thin(a))
    while len(merged) > 1 and thin(merged[-1]):
        tail = merged.pop()
        merged[-1] = [tail[0], merged[-1][1] + tail[1], merged[-1][2] + tail[2]]
    n = sum(b[1] for b in merged)
    mean_i = sum(i * b[1] for i, b in enumerate(merged)) / n
    mean_r = sum(b[2] for b in merged) / n
    slope = sum((i - mean_i) * (b[2] - mean_r * b[1]) for i, b in enumerate(merged))
    sign = 1 if slope >= 0 else -1
    return _pool(merged, lambda a, b: sign * (b[2] / b[1] - a[2] / a[1]) <= 0)


def fit_woe(df: DataFrame, columns: list[str], y: str, prebins: int = PREBINS, min_share: float = MIN_BIN,
            accuracy: int = 10000) -> dict[str, WoeModel]:
    """Fit all columns from two passes: sketches for the edges, one aggregation for the counts."""
    edges = quantile_edges(df, columns, prebins, accuracy)
    counts: dict[str, dict[int, tuple]] = {c: {} for c in columns}
    for r in bin_counts(df, columns, edges, y).collect():  # at most (prebins + 1) rows per column
        counts[r["feature"]][r["bin"]] = (r["n"], r["events"])
    return {c: _woe_model(c, edges[c], counts[c], min_share) for c in columns}


def _woe_model(column: str, edges: list[float], counts: dict[int, tuple], min_share: float) -> WoeModel:
    missing = counts.pop(-1, (0, 0.0))
    uppers = [*edges, math.inf]
    bins = [[uppers[i], counts[i][0], counts[i][1]] for i in sorted(counts)]
    n, e = sum(b[1] for b in bins) + missing[0], sum(b[2] for b in bins) + missing[1]
    if not bins or not 0 < e < n:
        return WoeModel(column, [], [0.0], 0.0)
    merged = merge_bins(bins, n, min_share)

    def woe(size: float, events: float) -> float:
        good, bad = (size - events) / (n - e), events / e
        return math.log(good / bad) if good > 0 and bad > 0 else 0.0

    return WoeModel(column, [b[0] for b in merged[:-1]], [woe(b[1], b[2]) for b in merged],
                    woe(*missing) if missing[0] else 0.0)
