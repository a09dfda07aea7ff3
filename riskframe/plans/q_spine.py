"""Registered queries: calendars, spines, point-in-time and interval joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import asof, calendar, interval, labels, spine
from ..operators.timekeys import DAY
from . import standins as v
from .registry import Tables, query


def _calendar(t: Tables, mode: str = "first", **kw):
    return calendar.feature_dates(t.spark, *v.period(t), mode=mode, **kw)


def _spine(t: Tables):
    return spine.member_spine(_calendar(t), v.members(t), ["segment"])


@query("m0_report_rate_by_segment", f"""
WITH {v.MEMBERS}, {v.REPORTS}, {v.CALENDAR}, {v.SPINE},
lab AS (SELECT s.company_id, s.timestamp, s.segment, min(r.reported_at) AS d FROM spine s LEFT JOIN reports r
  ON s.company_id = r.company_id AND r.reported_at BETWEEN s.timestamp AND s.timestamp + INTERVAL 90 DAY GROUP BY ALL),
tgt AS (SELECT *, CAST(d IS NOT NULL AS INT) AS event, coalesce(d - timestamp, 90) AS duration FROM lab)
SELECT timestamp AS feature_date, segment, count(*) AS companies, CAST(sum(event) AS BIGINT) AS events,
  round(avg(event), 6) AS event_rate, round(avg(duration), 4) AS mean_duration
FROM tgt WHERE duration > 0 GROUP BY ALL""")
def m0(t: Tables):
    dated = labels.first_report_after(_spine(t), v.reports(t))
    tgt = labels.event_targets(dated.withColumn("duration", labels.whole_days("first_report_at", "timestamp")))
    return (tgt.where("duration > 0").groupBy(F.col("timestamp").alias("feature_date"), "segment")
            .agg(F.count(F.lit(1)).alias("companies"), F.sum("event").alias("events"),
                 F.round(F.avg("event"), 6).alias("event_rate"), F.round(F.avg("duration"), 4).alias("mean_duration")))


MIX = "((year(m) * 12 + month(m)) * 31 + {draw}) * 7919 + {seed}) % 1000003"
MONTHS = "SELECT CAST(date_trunc('month', unnest(generate_series(date_trunc('month', (SELECT min(o_orderdate) FROM orders)), date_trunc('month', (SELECT max(o_orderdate) FROM orders)), INTERVAL 1 MONTH))) AS DATE) AS m"


def _orders_per_date(t: Tables, dates):
    """Orders placed in the month on or after each feature date."""
    o = t.orders.select(calendar.month_of("o_orderdate").alias("month"), F.col("o_orderdate").cast("date").alias("d"))
    per_day = o.groupBy("month", "d").agg(F.count(F.lit(1)).alias("n"))
    return (dates.join(per_day, "month", "left")
            .groupBy("month", "feature_date").agg(F.sum(F.when(F.col("d") >= F.col("feature_date"), F.col("n"))).alias("orders_after")))


def _dated_sql(dates: str) -> str:
    return f"""WITH months AS ({MONTHS}), dates AS ({dates})
SELECT m AS month, feature_date, CAST(sum(CASE WHEN o_orderdate >= feature_date THEN 1 END) AS BIGINT) AS orders_after
FROM dates LEFT JOIN orders ON CAST(date_trunc('month', o_orderdate) AS DATE) = m GROUP BY ALL"""


def _day(draw: str, seed: int) -> str:
    return f"m + CAST(((((year(m) * 12 + month(m)) * 31 + {draw}) * 7919 + {seed}) % 1000003) % day(last_day(m)) AS INT)"


@query("sp1_random_day_of_month", _dated_sql(f"SELECT m, {_day('0', 7)} AS feature_date FROM months"))
def sp1(t: Tables):
    a, z = v.period(t)
    return _orders_per_date(t, calendar.feature_dates(t.spark, a, z, "random", seed=7))


@query("sp2_first_day_of_month", _dated_sql("SELECT m, m AS feature_date FROM months"))
def sp2(t: Tables):
    a, z = v.period(t)
    return _orders_per_date(t, calendar.feature_dates(t.spark, a, z, "first"))


@query("sp3_k_days_of_month", _dated_sql(
    f"SELECT DISTINCT m, {_day('draw', 7)} AS feature_date FROM months, (SELECT unnest(range(3)) AS draw)"))
def sp3(t: Tables):
    a, z = v.period(t)
    return _orders_per_date(t, calendar.feature_dates(t.spark, a, z, "multiple", k=3, seed=7))


@query("sp4_dates_by_mode", f"""WITH months AS ({MONTHS}), dates AS (
  SELECT 'first' AS mode, m, m AS feature_date FROM months
  UNION ALL SELECT 'random', m, {_day('0', 7)} FROM months
  UNION ALL SELECT DISTINCT 'multiple', m, {_day('draw', 7)} FROM months, (SELECT unnest(range(3)) AS draw))
SELECT mode, month(m) AS month_no, count(*) AS n_dates, CAST(sum(day(feature_date)) AS BIGINT) AS day_sum
FROM dates GROUP BY ALL""")
def sp4(t: Tables):
    a, z = v.period(t)
    parts = [calendar.feature_dates(t.spark, a, z, m, seed=7).withColumn("mode", F.lit(m))
             for m in ("first", "random", "multiple")]
    dates = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return dates.groupBy("mode", F.month("month").alias("month_no")).agg(
        F.count(F.lit(1)).alias("n_dates"), F.sum(F.day("feature_date")).alias("day_sum"))


@query("sp5_month_list", f"""WITH months AS ({MONTHS})
SELECT m AS month, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total
FROM months LEFT JOIN orders ON CAST(date_trunc('month', o_orderdate) AS DATE) = m GROUP BY 1""")
def sp5(t: Tables):
    a, z = v.period(t)
    per_month = t.orders.groupBy(calendar.month_of("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    return calendar.months(t.spark, a, z).join(F.broadcast(per_month), "month", "left").select(
        "month", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"))


@query("sp6_member_spine", f"WITH {v.MEMBERS}, {v.CALENDAR}, {v.SPINE} SELECT company_id, timestamp, segment FROM spine")
def sp6(t: Tables):
    return _spine(t)


ACTIVE = """first_tx AS (SELECT company_id, min(transactiondate) AS first_transaction_at FROM transactions
  WHERE amount <> 0 AND transactiontype NOT IN ('Fee', 'Unknown') AND fullycleared = 1 GROUP BY 1)"""


@query("sp7_active_spine", f"""WITH {v.MEMBERS}, {v.TRANSACTIONS}, {v.CALENDAR}
SELECT DISTINCT m.company_id, feature_date AS timestamp FROM calendar, members m JOIN transactions x ON m.company_id = x.company_id
WHERE (is_rejected = 0 OR (is_rejected = 1 AND rejected_at > feature_date)) AND amount <> 0
  AND transactiontype NOT IN ('Fee', 'Unknown') AND transactiondate < feature_date AND fullycleared = 1""")
def sp7(t: Tables):
    return spine.active_member_spine(_calendar(t), v.members(t), v.transactions(t))


@query("sp8_tenure_spine", f"""WITH {v.MEMBERS}, {v.TRANSACTIONS}, {v.CALENDAR}, {v.SPINE}, {ACTIVE}
SELECT s.company_id, s.timestamp, s.timestamp - m.approved_at AS days_on_books,
  CASE WHEN f.first_transaction_at < s.timestamp THEN 1 ELSE 0 END AS is_ftt,
  CASE WHEN f.first_transaction_at < s.timestamp THEN f.first_transaction_at - m.approved_at END AS days_to_transact,
  365 - (s.timestamp - m.approved_at) AS days_remaining
FROM spine s JOIN members m ON s.company_id = m.company_id LEFT JOIN first_tx f ON s.company_id = f.company_id
WHERE s.timestamp - m.approved_at <= 365""")
def sp8(t: Tables):
    return spine.tenure_spine(_calendar(t), v.members(t), v.transactions(t), 365)


@query("sp9_multi_date_spine", f"""WITH {v.MEMBERS}, {v.CALENDAR}, {v.SPINE}
SELECT timestamp, count(*) AS companies, count(DISTINCT company_id) AS distinct_companies FROM spine GROUP BY 1""")
def sp9(t: Tables):
    return _spine(t).groupBy("timestamp").agg(F.count(F.lit(1)).alias("companies"),
                                              F.countDistinct("company_id").alias("distinct_companies"))


@query("sp10_duplicate_keys", """SELECT CAST(o_custkey AS VARCHAR) AS company_id, CAST(o_orderdate AS DATE) AS timestamp,
  count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def sp10(t: Tables):
    return spine.duplicate_spine_keys(t.orders.select(F.col("o_custkey").cast("string").alias("company_id"),
                                                      F.col("o_orderdate").cast("date").alias("timestamp")))


@query("sp11_numeric_ids", """SELECT lang, count(*) AS rows_kept, count(DISTINCT id) AS ids FROM (
  SELECT lang, CASE WHEN doc_id % 3 = 0 THEN source ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents)
WHERE TRY_CAST(id AS DOUBLE) IS NOT NULL GROUP BY 1""")
def sp11(t: Tables):
    ids = t.documents.select("lang", F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("doc_id").cast("string")).alias("id"))
    return spine.numeric_ids(ids, "id").groupBy("lang").agg(F.count(F.lit(1)).alias("rows_kept"), F.countDistinct("id").alias("ids"))


@query("sp12_period_guard", """SELECT year(o_orderdate) AS start_year, count(*) AS n_orders FROM orders
WHERE o_orderdate >= DATE '1995-06-01' AND o_orderdate < DATE '2000-01-01' GROUP BY 1""")
def sp12(t: Tables):
    start, stop = date(1995, 6, 1), date(2000, 1, 1)
    calendar.check_period(start, stop, earliest=date(1995, 6, 1))
    return t.orders.where((F.col("o_orderdate") >= F.lit(start)) & (F.col("o_orderdate") < F.lit(stop))).groupBy(
        F.year("o_orderdate").alias("start_year")).agg(F.count(F.lit(1)).alias("n_orders"))


@query("jn7_asof_features", """
WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, ts AS feature_ts, event_id AS feature_id, value FROM events WHERE event_type = 'view')
SELECT s.event_id, s.user_id, s.ts, f.feature_ts, f.feature_id, f.value
FROM s ASOF LEFT JOIN f ON s.user_id = f.user_id AND s.ts >= f.feature_ts""")
def jn7(t: Tables):
    e = t.events
    s = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    f = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("feature_ts"), F.col("event_id").alias("feature_id"), "value")
    return asof.asof_join(s, f, "user_id", "ts", "feature_ts", ["feature_id", "value"], tie_break=["feature_id"])


@query("jn7_asof_ttl_strict", """
WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type IN ('purchase', 'view')),
f AS (SELECT user_id, ts AS feature_ts, value FROM events WHERE event_type = 'view')
SELECT s.event_id, s.user_id, s.ts, CASE WHEN s.ts - f.feature_ts <= INTERVAL 1 DAY THEN f.feature_ts END AS feature_ts,
  CASE WHEN s.ts - f.feature_ts <= INTERVAL 1 DAY THEN f.value END AS value
FROM s ASOF LEFT JOIN f ON s.user_id = f.user_id AND s.ts > f.feature_ts""")
def jn7_ttl(t: Tables):
    e = t.events
    s = e.where(F.col("event_type").isin("purchase", "view")).select("event_id", "user_id", "ts")
    f = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("feature_ts"), "value")
    return asof.asof_join(s, f, "user_id", "ts", "feature_ts", ["value"], inclusive=False, ttl_seconds=DAY)


@query("jn8_interval_labels", f"""WITH {v.MEMBERS}, {v.REPORTS}, {v.CALENDAR}, {v.SPINE}
SELECT s.company_id, s.timestamp, r.report_id, r.reported_at FROM spine s JOIN reports r ON s.company_id = r.company_id
  AND r.reported_at BETWEEN s.timestamp AND s.timestamp + INTERVAL 90 DAY""")
def jn8(t: Tables):
    return interval.interval_join(_spine(t).select("company_id", "timestamp"), v.reports(t), "company_id",
                                  "timestamp", "reported_at", high=90 * DAY)
