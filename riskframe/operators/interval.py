"""Interval join: events inside a time range around each spine row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timekeys import DAY, MICROS, floor_bucket, micros


def interval_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str,
    right_ts: str,
    low: int = 0,
    high: int = 90 * DAY,
    bucket: int | None = None,
    low_open: bool = False,
    high_open: bool = False,
) -> DataFrame:
    """Inner join on ``key`` with ``right_ts`` in [left_ts+low, left_ts+high] seconds.

    Time is cut into buckets (default: the length of the range, so a left row meets two or
    three of them); the join stays an equi-join on (key, bucket), which splits a hot key
    over its buckets and lets the adaptive planner split a hot bucket. Columns of
    ``right`` other than the key must not clash with ``left``.
    """
    width = (bucket or max(high - low, 1)) * MICROS
    lo, hi = micros(left_ts) + low * MICROS, micros(left_ts) + high * MICROS
    l = left.withColumn("__bkt", F.explode(F.sequence(floor_bucket(lo, width), floor_bucket(hi, width))))
    r = right.withColumn("__bkt", floor_bucket(micros(right_ts), width)).withColumn("__rpos", micros(right_ts))
    lower = F.col("__rpos") > lo if low_open else F.col("__rpos") >= lo
    upper = F.col("__rpos") < hi if high_open else F.col("__rpos") <= hi
    return l.join(r, [key, "__bkt"]).where(lower & upper).drop("__bkt", "__rpos")


def interval_aggregate(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str,
    right_ts: str,
    aggs: list[Column],
    left_keys: list[str] | None = None,
    **bounds,
) -> DataFrame:
    """Aggregate the matching events of each left row; rows with no match keep nulls.

    Only the identifying columns of the left side travel through the join; the rest of the
    row is attached by the final join on the unique ``left_keys``.
    """
    ids = left_keys or [key, left_ts]
    hits = interval_join(left.select(*ids).distinct(), right, key, left_ts, right_ts, **bounds)
    return left.join(hits.groupBy(*ids).agg(*aggs), ids, "left")
