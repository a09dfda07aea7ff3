"""Calendars of feature dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import MIX_FACTOR, MIX_MODULUS

# Fixed value: earliest start of a dataset period.
EARLIEST_START = date(2018, 6, 1)


def check_period(start: date, stop: date, earliest: date = EARLIEST_START) -> None:
    """Raise unless the period starts on or after ``earliest`` and before ``stop``."""
    if start < earliest:
        raise ValueError(f"period starts {start}, before {earliest}")
    if not start < stop:
        raise ValueError(f"period start {start} is not before its stop {stop}")


def months(spark: SparkSession, start: date, stop: date) -> DataFrame:
    """First day of every month between two dates, both months included."""
    return spark.range(1).select(
        F.explode(F.sequence(F.trunc(F.lit(start), "month"), F.trunc(F.lit(stop), "month"),
                             F.expr("interval 1 month"))).alias("month"))


def month_of(ts: Column | str) -> Column:
    """First day of the month of a date or timestamp."""
    return F.trunc(F.col(ts).cast("date") if isinstance(ts, str) else ts.cast("date"), "month")


def month_number(month: Column) -> Column:
    return F.year(month).cast("long") * 12 + F.month(month)


def seeded_day(month: Column, draw: Column, seed: int = 0) -> Column:
    """Repeatable day of ``month``; the draw depends on the month, the draw number and the seed."""
    mixed = F.pmod((month_number(month) * 31 + draw) * F.lit(MIX_FACTOR) + F.lit(seed), F.lit(MIX_MODULUS))
    return F.date_add(month, F.pmod(mixed, F.day(F.last_day(month))).cast("int"))


def feature_dates(spark: SparkSession, start: date, stop: date, mode: str = "random",
                  k: int = 3, seed: int = 0, distinct: bool = True) -> DataFrame:
    """Dates of a period: ``first`` day, one ``random`` day or ``k`` random days of each month.

    The k days are drawn with replacement; ``distinct=False`` keeps the repeats.
    """
    cal = months(spark, start, stop)
    if mode == "first":
        return cal.select(F.col("month"), F.col("month").alias("feature_date"))
    if mode == "random":
        return cal.select("month", seeded_day(F.col("month"), F.lit(0), seed).alias("feature_date"))
    if mode != "multiple":
        raise ValueError(f"unknown mode {mode!r}")
    drawn = cal.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        "month", seeded_day(F.col("month"), F.col("draw"), seed).alias("feature_date"))
    return drawn.distinct() if distinct else drawn
