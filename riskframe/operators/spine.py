"""Observation spines: which company is looked at on which date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Transaction types that do not count as activity.
INACTIVE_TYPES = ("Fee", "Unknown")


MEMBERSHIP = ("is_approved", "approved_at", "is_rejected", "rejected_at")


def is_member_at(day: Column, of: Callable[[str], Column] = F.col) -> Column:
    """Approved before ``day`` and not rejected, or rejected only after it; ``of`` finds the columns of ``MEMBERSHIP``."""
    return (
        (of("is_approved") == 1) & (of("approved_at") < day)
        & ((of("is_rejected") == 0) | ((of("is_rejected") == 1) & (of("rejected_at") > day)))
    )


def member_spine(calendar: DataFrame, members: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per (company, date) for every member at each date of the calendar.

    The calendar is a few dates, so it is broadcast and the member table is read once for
    the whole period. A company with several memberships that count at a date comes out once,
    with the smallest of each carried column.
    """
    dates = calendar.select(F.col("feature_date")).distinct()
    rows = members.join(F.broadcast(dates), is_member_at(F.col("feature_date"))).select(
        "company_id", F.col("feature_date").alias("timestamp"), *(carry or []))
    if not carry:
        return rows.distinct()
    return rows.groupBy("company_id", "timestamp").agg(*[F.min(c).alias(c) for c in carry])


def first_activity(transactions: DataFrame) -> DataFrame:
    """First cleared, non-zero transaction of a counted type per company."""
    return (
        transactions.where(
            (F.col("amount") != 0) & (~F.col("transactiontype").isin(*INACTIVE_TYPES)) & (F.col("fullycleared") == 1))
        .groupBy("company_id").agg(F.min("transactiondate").alias("first_transaction_at"))
    )


def active_member_spine(calendar: DataFrame, members: DataFrame, transactions: DataFrame) -> DataFrame:
    """Members with at least one counted transaction before the date (approval not asked)."""
    dates = calendar.select("feature_date").distinct()
    day = F.col("feature_date")
    return (
        members.join(first_activity(transactions), "company_id")
        .join(F.broadcast(dates),
              ((F.col("is_rejected") == 0) | ((F.col("is_rejected") == 1) & (F.col("rejected_at") > day)))
              & (F.col("first_transaction_at") < day))
        .select("company_id", day.alias("timestamp")).distinct()
    )


def tenure_spine(calendar: DataFrame, members: DataFrame, transactions: DataFrame, period_days: int) -> DataFrame:
    """Members still inside their first ``period_days`` on books, with tenure columns.

    ``is_ftt`` is 1 once the first transaction happened before the date; ``days_to_transact``
    is null until then; ``days_remaining`` counts down to the end of the tenure period.
    """
    spine = member_spine(calendar, members, ["approved_at"])
    day = F.col("timestamp")
    done = F.col("first_transaction_at") < day
    on_books = F.datediff(day, F.col("approved_at"))
    return (
        spine.where(on_books <= period_days)
        .join(first_activity(transactions), "company_id", "left")
        .select("company_id", "timestamp", on_books.alias("days_on_books"),
                F.coalesce(done.cast("int"), F.lit(0)).alias("is_ftt"),
                F.when(done, F.datediff("first_transaction_at", "approved_at")).alias("days_to_transact"),
                (F.lit(period_days) - on_books).alias("days_remaining"))
    )


def duplicate_spine_keys(spine: DataFrame, keys: tuple[str, ...] = ("company_id", "timestamp")) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return spine.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(spine: DataFrame, keys: tuple[str, ...] = ("company_id", "timestamp")) -> DataFrame:
    """Return the spine, or raise when a key repeats (runs one job)."""
    if not duplicate_spine_keys(spine, keys).isEmpty():
        raise ValueError(f"spine keys {keys} are not unique")
    return spine


def numeric_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Keep rows whose id reads as a number."""
    return df.where(F.col(id_col).try_cast("double").isNotNull())
