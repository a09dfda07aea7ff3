"""Company histories: cut at the first positives, padded sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cut_after_positive(df: DataFrame, key: str, order: list[str], label: str, m: int = 1) -> DataFrame:
    """Rows up to and including the ``m``-th positive of each company.

    Only the m first positives per key are ranked (rows beyond m are dropped before the
    shuffle), then each row is compared with the position of the m-th.
    """
    pos = F.struct(*order)
    rn = F.row_number().over(W.partitionBy(key).orderBy(*order))
    nth = (df.where(F.col(label) == 1).select(key, *order).withColumn("__rn", rn).where(F.col("__rn") <= m)
           .groupBy(F.col(key).alias("__key")).agg(F.max(pos).alias("__nth"), F.count(F.lit(1)).alias("__n")))
    joined = df.join(nth, F.col(key) == F.col("__key"), "left")
    keep = F.col("__nth").isNull() | (F.col("__n") < m) | (pos <= F.col("__nth"))
    return joined.where(keep).select(*df.columns)


def padded_sequences(df: DataFrame, key: str, order: list[str], features: list[str], label: str,
                     amount: str, segment: str, steps: int = 5) -> DataFrame:
    """Last ``steps`` rows per company, oldest first, zero-padded on the left.

    Outputs x (array of feature arrays), y, y2 (amount), segment and the not-padded mask.
    ``row_number() <= steps`` keeps at most ``steps`` rows per key and map task before the
    shuffle, so a long history is never gathered.
    """
    newest = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    zero = F.lit(0.0)
    vector = F.array(*[F.coalesce(F.col(c).cast("double"), zero) for c in features])
    last = df.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= steps)
    packed = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("__rn")).alias("pos"), vector.alias("x"), F.col(label).cast("double").alias("y"),
        F.coalesce(F.col(amount).cast("double"), zero).alias("y2"), (F.col(segment) > 0).cast("int").alias("s")))).alias("__h"))
    missing = F.lit(steps) - F.size("__h")

    def pad(value: Column, field: str) -> Column:
        return F.concat(F.array_repeat(value, missing), F.transform("__h", lambda r: r[field]))

    return packed.select(
        key, pad(F.array(*[zero] * len(features)), "x").alias("x"), pad(zero, "y").alias("y"), pad(zero, "y2").alias("y2"),
        pad(F.lit(0), "s").alias("segment"),
        F.concat(F.array_repeat(F.lit(0), missing), F.transform("__h", lambda r: F.lit(1))).alias("not_padded"))


def history_shape(df: DataFrame, key: str, steps: int = 5) -> DataFrame:
    """Companies, rows per company and the share of padded steps."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    used = F.sum(F.least("n", F.lit(steps)))
    return per.agg(F.count(F.lit(1)).alias("companies"), (F.sum("n") / F.count(F.lit(1))).alias("rows_per_company"),
                   (1 - used / (F.count(F.lit(1)) * steps)).alias("padded_share"))
