"""Event, duration and multi-horizon labels for spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .interval import interval_aggregate, interval_join
from .spine import MEMBERSHIP, is_member_at
from .timekeys import DAY, MICROS, micros

# The report horizon and the fraud horizons, in days.
REPORT_DAYS = 90
HORIZONS = (30, 45, 60, 90)


def whole_days(later: Column | str, earlier: Column | str) -> Column:
    """Whole days between two timestamps, rounded down."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(DAY * MICROS)).cast("int")


def window_end(ts: Column | str, days: int = REPORT_DAYS) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return c + F.expr(f"interval {days} days")


def first_reports(tickets: DataFrame, changes: DataFrame, project: str, issue_types: list[str],
                  outcomes: list[str], id_pattern: str = "[0-9]{4,}", skip_status: str = "Duplicates") -> DataFrame:
    """First report day per company from tickets and their change log.

    The company id is the first match of ``id_pattern`` in the ticket summary. A subtask
    flag of null counts as "not a subtask".
    """
    kept = tickets.where(
        (F.col("project_key") == project) & F.trim("issue_type").isin(issue_types)
        & (F.col("ticket_status").isNull() | (F.col("ticket_status") != skip_status))
        & ~F.col("is_subtask").eqNullSafe(1)
    ).select("ticket_id", F.regexp_substr(F.trim("ticket_summary"), F.lit(id_pattern)).alias("company_id"))
    # the filter on the change log makes the left join an inner one
    moved = changes.where(F.col("new_value").isin(outcomes)).select("ticket_id", "change_at")
    return (kept.join(moved, "ticket_id").groupBy("company_id")
            .agg(F.min(F.to_date("change_at")).alias("first_report_at")))


def first_report_after(spine: DataFrame, reports: DataFrame, days: int = REPORT_DAYS,
                       report_ts: str = "reported_at") -> DataFrame:
    """Add the earliest report date in [timestamp, timestamp + days] to each spine row."""
    return interval_aggregate(spine, reports.select("company_id", report_ts), "company_id", "timestamp", report_ts,
                              [F.min(report_ts).alias("first_report_at")], high=days * DAY)


def member_first_reports(calendar: DataFrame, members: DataFrame, reports: DataFrame, days: int = REPORT_DAYS,
                         report_ts: str = "reported_at", by: list[str] | None = None) -> DataFrame:
    """``first_report_after`` of ``member_spine``, without ever shuffling the spine.

    Memberships and report days are gathered to one row per company, and those rows are all that is shuffled; the dates
    of the calendar (broadcast) multiply them afterwards. Reports are dates, so a company has no more of them than there
    are days. ``by`` names calendar columns to keep, such as a mode: the spine is then one for each of their values.
    """
    by, day = by or [], F.col("feature_date")
    held = members.groupBy("company_id").agg(F.collect_set(F.struct(*MEMBERSHIP)).alias("__held"))
    told = reports.groupBy("company_id").agg(F.collect_set(F.col(report_ts).cast("date")).alias("__told"))
    dates = F.broadcast(calendar.select(*by, day).distinct())
    rows = held.join(told, "company_id", "left").join(dates, F.exists("__held", lambda m: is_member_at(day, m.getField)))
    inside = F.filter("__told", lambda r: r.between(day, F.date_add(day, days)))
    return rows.select("company_id", *by, day.alias("timestamp"), F.array_min(inside).alias("first_report_at"))


def report_durations(spine: DataFrame, reports: DataFrame, days: int = REPORT_DAYS,
                     report_ts: str = "reported_at") -> DataFrame:
    """Days to each report inside the window, one row per (company, date, duration)."""
    hits = interval_join(spine.select("company_id", "timestamp"), reports.select("company_id", report_ts),
                         "company_id", "timestamp", report_ts, high=days * DAY)
    return hits.select("company_id", "timestamp", whole_days(report_ts, "timestamp").alias("duration")).distinct()


def event_targets(df: DataFrame, duration: str = "duration", days: int = REPORT_DAYS) -> DataFrame:
    """``event`` = label present; ``duration`` censored at the horizon when absent."""
    return df.withColumn("event", F.col(duration).isNotNull().cast("int")).withColumn(
        duration, F.coalesce(F.col(duration), F.lit(days)))


def days_since_incorporation(incorporated: str, report: str, ts: str, days: int = REPORT_DAYS) -> Column:
    """Days from incorporation to the first report, or to the window end without one."""
    end = F.coalesce(F.col(report).cast("date"), F.date_add(F.col(ts).cast("date"), days))
    return F.datediff(end, F.col(incorporated).cast("date"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in ``order`` (total up to ties of whole rows).

    ``row_number() <= 1`` lets the planner keep one row per key before the shuffle.
    """
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def fraud_list(frauds: DataFrame, start, stop, horizon_days: int = 90) -> DataFrame:
    """Distinct frauds dated in the period extended by the label horizon."""
    upper = F.date_add(F.lit(stop).cast("date"), horizon_days)
    return (frauds.where(F.col("transaction_at").cast("date").between(F.lit(start).cast("date"), upper))
            .dropDuplicates(["company_id", "transaction_at", "app_fraud_type", "amount"]))


def spine_frauds(spine: DataFrame, frauds: DataFrame, max_days: int | None = None) -> DataFrame:
    """Qualifying frauds per spine row: after the date and within the days remaining.

    The reference joins all frauds and blanks the others; here the time test is part of the
    interval join. Two frauds at one instant are one, the larger amount first. The join
    reaches as far as the largest ``days_remaining``, which is looked up; ``max_days`` may widen it but loses nothing.
    """
    most = spine.agg(F.max("days_remaining")).first()[0]
    max_days = max(int(most or 0), max_days or 0)
    one = first_per_key(frauds, ["company_id", "transaction_at"],
                        [F.col("amount").desc(), F.col("app_fraud_type")])
    hits = interval_join(spine.select("company_id", "timestamp", "days_remaining"), one, "company_id",
                         "timestamp", "transaction_at", high=(max_days + 1) * DAY, low_open=True)
    return (hits.withColumn("days", whole_days("transaction_at", "timestamp"))
            .where(F.col("days") <= F.col("days_remaining"))
            .select("company_id", "timestamp", "days", "amount", "app_fraud_type").distinct())


def array_labels(spine: DataFrame, hits: DataFrame) -> DataFrame:
    """Sorted array of (days, amount, type) per spine row; empty when nothing qualifies.

    The array holds the frauds of one company inside one tenure period; ``horizon_labels``
    gives the same labels without ever building it.
    """
    packed = hits.groupBy("company_id", "timestamp").agg(
        F.array_sort(F.collect_list(F.struct("days", "amount", "app_fraud_type"))).alias("frauds"))
    empty = F.array().cast("array<struct<days:int,amount:double,app_fraud_type:string>>")
    return spine.join(packed, ["company_id", "timestamp"], "left").withColumn(
        "frauds", F.coalesce("frauds", empty))


def horizon_columns(frauds: str = "frauds", horizons: tuple[int, ...] = HORIZONS,
                    null_policy: str = "skip") -> list[Column]:
    """Flag, first days, amount and types within each horizon, from the label array.

    ``skip`` ignores frauds outside the horizon and leaves the amount null when none is
    inside; ``propagate`` also nulls days and amount when the array is empty.
    """
    if null_policy not in ("skip", "propagate"):
        raise ValueError(null_policy)
    out = []
    a = F.col(frauds)
    for h in horizons:
        inside = F.filter(a, lambda x: x["days"] <= h)
        some = F.size(inside) > 0
        out += [
            some.cast("int").alias(f"is_app_fraud_{h}d"),
            F.array_min(F.transform(inside, lambda x: x["days"])).alias(f"days_to_fraud_{h}d"),
            F.when(some, F.aggregate(inside, F.lit(0.0), lambda s, x: s + F.coalesce(x["amount"], F.lit(0.0))))
            .alias(f"app_fraud_amount_{h}d"),
            F.transform(inside, lambda x: x["app_fraud_type"]).alias(f"app_fraud_type_{h}d"),
        ]
    return out


def horizon_labels(spine: DataFrame, hits: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """The scalar horizon labels by conditional aggregation, combined before the shuffle."""
    aggs = []
    for h in horizons:
        inside = F.col("days") <= h
        aggs += [F.max(inside.cast("int")).alias(f"is_app_fraud_{h}d"),
                 F.min(F.when(inside, F.col("days"))).alias(f"days_to_fraud_{h}d"),
                 F.sum(F.when(inside, F.col("amount"))).alias(f"app_fraud_amount_{h}d")]
    labels = hits.groupBy("company_id", "timestamp").agg(*aggs)
    flags = [f"is_app_fraud_{h}d" for h in horizons]
    return spine.join(labels, ["company_id", "timestamp"], "left").fillna(0, flags)


def explode_labels(df: DataFrame, arrays: list[str], keep: Column | None = None) -> DataFrame:
    """Parallel arrays to one row per element (rows with empty arrays stay, as nulls)."""
    others = [c for c in df.columns if c not in arrays]
    rows = df.select(*others, F.inline_outer(F.arrays_zip(*arrays)))
    return rows if keep is None else rows.where(keep)
