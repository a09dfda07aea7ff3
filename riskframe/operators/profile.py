"""Column profiles, describes, class profiles and shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .chunks import CHUNKS, attach_totals, exact_quantiles

GRID = [i / 20 for i in range(21)]


def describe(df: DataFrame, column: str, keys: list[str] | None = None, probs: list[float] | None = None,
             n_chunks: int | None = CHUNKS) -> DataFrame:
    """Count, mean, std, min, exact quantiles (21-point grid) and max, per key or overall."""
    keys, probs = keys or [], probs or GRID
    c = F.col(column)
    base = df.groupBy(*keys).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                                 F.min(c).alias("min"), F.max(c).alias("max"))
    q = exact_quantiles(df, keys, column, probs, n_chunks=n_chunks)
    return attach_totals(base, keys, q)


def weighted_mean(x: Column, w: Column) -> Column:
    """Weighted mean of the non-null values."""
    return F.try_divide(F.sum(F.when(x.isNotNull(), x * w)), F.sum(F.when(x.isNotNull(), w)))


def weighted_std(x: Column, w: Column) -> Column:
    """Weighted population standard deviation in two-moment form."""
    mu, sq = weighted_mean(x, w), weighted_mean(x * x, w)
    return F.sqrt(F.greatest(sq - mu * mu, F.lit(0.0)))


def level_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and percent share of each level, rounded half-even to 2 digits."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("__total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.bround(F.col("n") * 100 / F.col("__total"), 2).alias("pct"))


def class_profile(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Mean of each column per class, one row per column: (column, mean_<class>...) tidy form."""
    means = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])
    return means.unpivot([label], columns, "column", "mean")


def column_profile(df: DataFrame, numeric: list[str], text: list[str], top_k: int = 3) -> DataFrame:
    """Tidy profile: count, null share, approximate distinct, numeric moments and the top values.

    All scalar statistics come from one aggregation of the whole table.
    """
    cols = [*numeric, *text]

    def stat(c: str) -> Column:
        x, nothing = F.col(c), F.lit(None).cast("double")
        d = x.cast("double") if c in numeric else nothing
        return F.struct(F.count(x).alias("count"), F.avg(x.isNull().cast("int")).alias("null_rate"),
                        F.approx_count_distinct(x).alias("distinct_approx"), F.avg(d).alias("mean"),
                        F.stddev_samp(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"))

    one = df.agg(*[stat(c).alias(c) for c in cols])
    tidy = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in cols])).alias("r"))
    tops = top_values(df, cols, top_k)
    per = tops.groupBy("column").agg(F.concat_ws("|", F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda r: r["value"])).alias("top_values"))
    return tidy.select("r.column", "r.s.*").join(F.broadcast(per), "column", "left")


SKETCH_K = 400
RANK_ERROR = 0.02  # of a quantile's rank, with room to spare for ``SKETCH_K``


def column_sketches(df: DataFrame, columns: list[str], keys: tuple[str, ...] = (), k: int = SKETCH_K) -> DataFrame:
    """Quantile sketches of all columns in one aggregation: (keys, column, n, sketch).

    Sketches have a fixed size whatever the rows, and can be stored by partition and merged later. Nulls are left out.
    """
    stat = lambda c: F.struct(F.count(c).alias("n"), F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias("sketch"))
    one = df.groupBy(*keys).agg(*[stat(c).alias(f"__{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("s")) for i, c in enumerate(columns)])).alias("r")
    return one.select(*keys, rows).select(*keys, "r.column", "r.s.n", "r.s.sketch")


def merge_sketches(sketches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sketches of whole columns, or of coarser ``keys``, from those of partitions: (keys, column, n, sketch)."""
    return sketches.groupBy(*keys, "column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """One row for each sketch and probability: its columns but the sketch, ``p`` and ``value``; null for a column without values.

    The rank of ``value`` is within ``RANK_ERROR`` of ``p``.
    """
    value = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))
    found = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), value(p).alias("value")) for p in probs])).alias("q")
    return sketches.select("*", found).select("*", "q.*").drop("q", "sketch")


def top_values(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """Most frequent values of each column, ties by value."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    counts = long.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_summary_rows(table: DataFrame, label_col: str, digits: int = 3) -> DataFrame:
    """Append rows ``Average`` and ``Std`` (sample) of the numeric columns, rounded half-even."""
    nums = [c for c, k in table.dtypes if c != label_col and k in ("double", "bigint", "int")]
    def line(name, fn):
        return table.agg(*[F.bround(fn(c), digits).alias(c) for c in nums]).withColumn(label_col, F.lit(name))
    typed = table.select(label_col, *[F.bround(F.col(c).cast("double"), digits).alias(c) for c in nums])
    return reduce(DataFrame.unionByName, [typed, line("Average", F.avg), line("Std", F.stddev_samp)])


def risk_trend(df: DataFrame, month: str, level: str, event: str, digits: int = 3) -> DataFrame:
    """Share and event rate (percent) of each risk level per month, plus Average and Std rows.

    One grouped aggregation; a level missing in a month counts as 0.
    """
    levels = ["High", "Medium", "Low"]
    n = F.count(F.lit(1))
    cols = []
    for lv in levels:
        at = F.col(level) == lv
        cols += [(F.count_if(at) * 100.0 / n).alias(f"share_{lv.lower()}"),
                 F.coalesce(F.avg(F.when(at, F.col(event))) * 100.0, F.lit(0.0)).alias(f"rate_{lv.lower()}")]
    return with_summary_rows(df.groupBy(month).agg(*cols), month, digits)
