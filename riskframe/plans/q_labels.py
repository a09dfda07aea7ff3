"""Registered queries: label builders and cleared-transaction facts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import labels, transactions
from ..session import cut_lineage
from . import standins as v
from .q_relational import TARGETS, _targets
from .q_spine import _calendar, _spine
from .registry import Tables, query
from .standins import R, rnd

# ---- JSON payload stand-in: events wrapped as payment payloads, some of them broken --------

RECEIVED, CREATED = "txn.received", "txn.created"
START, STOP, SWITCH = datetime(2024, 1, 2), datetime(2024, 1, 29), datetime(2024, 1, 15)
CODE = "CASE event_id % 3 WHEN 0 THEN 'DOMESTIC_TRANSFER' WHEN 1 THEN 'INTERNAL_BOOK_TRANSFER' ELSE 'CARD' END"
IDENT = "CASE WHEN event_id % 13 <> 0 THEN concat('  04', lpad(CAST(user_id AS VARCHAR(10)), 4, '0'), lpad(CAST((event_id * 1013) % 100000000 AS VARCHAR(10)), 8, '0'), ' ') END"


def _payloads(t: Tables):
    e = t.events
    k = F.col("event_id")
    received = k % 2 == 0
    cents = F.round(F.col("value") * 100).cast("long")
    payload = F.to_json(F.struct(
        F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("accountId"), F.concat(F.lit("T"), k.cast("string")).alias("transactionId"),
        F.struct(F.when(received, cents).alias("value"), F.when(~received, cents).alias("amount")).alias("amount"),
        F.struct(F.expr(IDENT).alias("identification")).alias("creditorAccount"),
        F.struct(F.concat(F.lit("D"), (k % 50).cast("string")).alias("identification")).alias("debtorAccount"),
        F.struct(F.expr(CODE).alias("code"), F.when(k % 5 == 0, "OTHER").otherwise("HOME").alias("issuer")).alias("proprietaryBankTransactionCode"),
        F.when(k % 4 == 0, "PENDING").otherwise("CLEARED").alias("status"),
        F.when(F.col("event_type").isin("signup", "click"), "CREDIT").otherwise("DEBIT").alias("creditDebitIndicator")))
    return e.select(F.col("ts").alias("timestamp"), F.when(received, RECEIVED).otherwise(CREATED).alias("event_type"),
                    F.when(k % 17 == 0, F.concat(payload, F.lit("}{"))).otherwise(payload).alias("payload"))


def _cleared_sql(extra: str = "") -> str:
    return f"""SELECT ts AS timestamp, 'A' || user_id AS account_id, 'T' || event_id AS transaction_id,
  coalesce(right(trim({IDENT}), 8), '-') AS destination_account_id, coalesce(left(trim({IDENT}), 6), '-') AS destination_sort_code,
  'D' || (event_id % 50) AS source_account_identification, CASE WHEN event_id % 5 = 0 THEN 'OTHER' ELSE 'HOME' END AS issuer,
  {R('round(value * 100) / 100.0', 2)} AS requested_payment_value
FROM events WHERE ts > TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-29' AND event_id % 17 <> 0 AND event_id % 3 < 2 AND event_id % 4 <> 0
  AND ((event_id % 2 = 0 AND ts < TIMESTAMP '2024-01-15') OR (event_id % 2 = 1 AND ts >= TIMESTAMP '2024-01-15')) {extra}"""


def _cleared(t: Tables, **kw):
    out = transactions.cleared_transactions(_payloads(t), START, STOP, RECEIVED, CREATED, switch=SWITCH, **kw)
    return out.withColumn("requested_payment_value", rnd("requested_payment_value", 2))


@query("lb13_fl4_cleared_both", _cleared_sql())
def lb13_both(t: Tables):
    return _cleared(t)


@query("lb13_fl4_cleared_debit", _cleared_sql("AND event_type NOT IN ('signup', 'click') AND event_id % 5 <> 0"))
def lb13_debit(t: Tables):
    return _cleared(t, side="DEBIT", issuer="HOME")


@query("lb13_fl4_cleared_credit", _cleared_sql("AND event_type IN ('signup', 'click')"))
def lb13_credit(t: Tables):
    return _cleared(t, side="CREDIT")


@query("lb13_jn1_with_company", f"""WITH c AS ({_cleared_sql()}) SELECT transaction_id, CAST(c_custkey AS VARCHAR) AS company_id, c_mktsegment AS risk_score, requested_payment_value
FROM c JOIN customer ON account_id = 'A' || c_custkey""")
def lb13_company(t: Tables):
    c = t.customer
    accounts = c.select(F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("account_id"), F.col("c_custkey").alias("company_id"))
    companies = c.select(F.col("c_custkey").alias("company_id"), (F.col("c_custkey") + 7).alias("membership_id"))
    members = c.select((F.col("c_custkey") + 7).alias("membership_id"), F.col("c_mktsegment").alias("risk_score"))
    return transactions.with_company(_cleared(t), accounts, companies, members).select("transaction_id", "company_id", "risk_score", "requested_payment_value")


# ---- report labels -------------------------------------------------------------------------

@query("lb1_first_reports", """SELECT regexp_extract(s, '[0-9]{4,}') AS company_id, min(CAST(l_shipdate AS DATE)) AS first_report_at FROM (
  SELECT o_orderkey, 'case for ' || (1000 + o_custkey) || ' opened' AS s, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 2 AS INT) END AS sub,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Duplicates' WHEN o_orderkey % 3 = 1 THEN 'Open' END AS st FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) o
JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND (st IS NULL OR st <> 'Duplicates') AND (NOT (sub = 1) OR (sub = 1) IS NULL) GROUP BY 1""")
def lb1(t: Tables):
    k = F.col("o_orderkey")
    tk = t.orders.select(
        k.alias("ticket_id"), F.lit("RC").alias("project_key"), F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")).alias("issue_type"),
        F.concat(F.lit("case for "), (F.col("o_custkey") + 1000).cast("string"), F.lit(" opened")).alias("ticket_summary"),
        F.when(k % 3 == 0, "Duplicates").when(k % 3 == 1, "Open").alias("ticket_status"), F.when(k % 5 != 0, (k % 2).cast("int")).alias("is_subtask"))
    ch = t.lineitem.select(F.col("l_orderkey").alias("ticket_id"), F.col("l_returnflag").alias("new_value"), F.col("l_shipdate").alias("change_at"))
    return labels.first_reports(tk, ch, "RC", ["1-URGENT", "2-HIGH"], ["R"])


@query("lb2_report_durations", f"""WITH {v.MEMBERS}, {v.REPORTS}, {v.CALENDAR}, {v.SPINE} SELECT DISTINCT s.company_id, s.timestamp, CAST(r.reported_at - s.timestamp AS INT) AS duration
FROM spine s JOIN reports r ON s.company_id = r.company_id AND r.reported_at BETWEEN s.timestamp AND s.timestamp + INTERVAL 90 DAY""")
def lb2(t: Tables):
    return labels.report_durations(_spine(t), v.reports(t))


@query("lb3_event_targets", f"{TARGETS} SELECT company_id, timestamp, event, duration FROM tgt")
def lb3(t: Tables):
    return _targets(t).select("company_id", "timestamp", "event", "duration")


@query("lb4_days_since_incorporation", f"""WITH {v.MEMBERS}, {v.REPORTS}, {v.CALENDAR}, {v.SPINE},
d AS (SELECT s.company_id, s.timestamp, min(r.reported_at) AS first_at FROM spine s LEFT JOIN reports r ON s.company_id = r.company_id
  AND r.reported_at BETWEEN s.timestamp AND s.timestamp + INTERVAL 90 DAY GROUP BY s.company_id, s.timestamp)
SELECT d.company_id, d.timestamp, CAST(coalesce(first_at, d.timestamp + 90) - m.approved_at AS INT) AS days_since_incorp, CAST(d.timestamp - m.approved_at AS INT) AS days_since_incorp_at_ts
FROM d JOIN members m ON d.company_id = m.company_id""")
def lb4(t: Tables):
    from ..operators import spine

    s = spine.member_spine(_calendar(t), v.members(t), ["approved_at"])
    d = labels.first_report_after(s, v.reports(t))
    return d.select("company_id", "timestamp", labels.days_since_incorporation("approved_at", "first_report_at", "timestamp").alias("days_since_incorp"),
                    F.datediff("timestamp", "approved_at").alias("days_since_incorp_at_ts"))


# ---- fraud arrays and horizons ---------------------------------------------------------------

FRAUDS = """frauds AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS company_id, o_orderdate AS transaction_at, o_orderpriority AS app_fraud_type, o_totalprice AS amount FROM orders
  WHERE o_orderstatus = 'F' ),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, transaction_at ORDER BY amount DESC, app_fraud_type) AS rn FROM frauds) WHERE rn = 1)"""
TENURE = f"""WITH {v.MEMBERS}, {v.CALENDAR}, {v.SPINE}, {FRAUDS},
ten AS (SELECT s.company_id, s.timestamp, 120 - (s.timestamp - m.approved_at) AS days_remaining FROM spine s JOIN members m ON s.company_id = m.company_id WHERE s.timestamp - m.approved_at <= 120),
hits AS (SELECT DISTINCT t.company_id, t.timestamp, CAST(datediff('day', t.timestamp, f.transaction_at) AS INT) AS days, f.amount, f.app_fraud_type FROM ten t JOIN one f ON t.company_id = f.company_id
  AND f.transaction_at > t.timestamp AND datediff('day', t.timestamp, f.transaction_at) <= t.days_remaining)"""


def _fraud_inputs(t: Tables):
    from ..operators import spine

    f = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("company_id"), F.col("o_orderdate").alias("transaction_at"),
                                                    F.col("o_orderpriority").alias("app_fraud_type"), F.col("o_totalprice").alias("amount"))
    frauds = labels.fraud_list(f, *v.period(t))
    ten = spine.tenure_spine(_calendar(t), v.members(t), v.transactions(t), 120).select("company_id", "timestamp", "days_remaining")
    return ten, frauds


@query("lb5_fraud_list", f"WITH {FRAUDS} SELECT company_id, transaction_at, app_fraud_type, amount FROM frauds")
def lb5(t: Tables):
    return _fraud_inputs(t)[1]


@query("lb6_jn10_spine_frauds", f"{TENURE} SELECT company_id, timestamp, days, amount, app_fraud_type FROM hits")
def lb6(t: Tables):
    ten, frauds = _fraud_inputs(t)
    return labels.spine_frauds(ten, frauds, 120)


def _joined(field: str, filt: str = "") -> str:
    return f"coalesce(string_agg(CAST({field} AS VARCHAR), ',' ORDER BY days, amount, app_fraud_type) {filt}, '')"


@query("lb7_ag6_array_labels", f"""{TENURE} SELECT t.company_id, t.timestamp, CAST(count(days) AS INT) AS n_frauds, {_joined('days')} AS days, {_joined('app_fraud_type')} AS types,
  {R('coalesce(sum(amount), 0)', 2)} AS amount FROM ten t LEFT JOIN hits h ON t.company_id = h.company_id AND t.timestamp = h.timestamp GROUP BY t.company_id, t.timestamp""")
def lb7(t: Tables):
    ten, frauds = _fraud_inputs(t)
    a = labels.array_labels(ten, labels.spine_frauds(ten, frauds, 120))
    return a.select("company_id", "timestamp", F.size("frauds").alias("n_frauds"), F.array_join(F.transform("frauds", lambda x: x["days"].cast("string")), ",").alias("days"),
                    F.array_join(F.transform("frauds", lambda x: x["app_fraud_type"]), ",").alias("types"),
                    rnd(F.aggregate("frauds", F.lit(0.0), lambda s, x: s + x["amount"]), 2).alias("amount"))


H = labels.HORIZONS


@query("lb8_horizon_labels", f"{TENURE} SELECT t.company_id, t.timestamp, " + ", ".join(
    f"CAST(count(CASE WHEN days <= {h} THEN 1 END) > 0 AS INT) AS is_app_fraud_{h}d, min(CASE WHEN days <= {h} THEN days END) AS days_to_fraud_{h}d, "
    f"{R(f'sum(CASE WHEN days <= {h} THEN amount END)', 2)} AS app_fraud_amount_{h}d" for h in H)
    + " FROM ten t LEFT JOIN hits h ON t.company_id = h.company_id AND t.timestamp = h.timestamp GROUP BY t.company_id, t.timestamp")
def lb8(t: Tables):
    ten, frauds = _fraud_inputs(t)
    out = labels.horizon_labels(ten.drop("days_remaining"), labels.spine_frauds(ten, frauds, 120))
    return out.select(*[rnd(c, 2).alias(c) if c.startswith("app_fraud_amount") else F.col(c) for c in out.columns])


@query("lb8_horizon_labels_from_arrays", f"{TENURE} SELECT t.company_id, t.timestamp, " + ", ".join(
    f"CAST(count(CASE WHEN days <= {h} THEN 1 END) > 0 AS INT) AS is_app_fraud_{h}d, min(CASE WHEN days <= {h} THEN days END) AS days_to_fraud_{h}d, "
    f"{R(f'sum(CASE WHEN days <= {h} THEN amount END)', 2)} AS app_fraud_amount_{h}d, {_joined('app_fraud_type', f'FILTER (WHERE days <= {h})')} AS app_fraud_type_{h}d" for h in H)
    + " FROM ten t LEFT JOIN hits h ON t.company_id = h.company_id AND t.timestamp = h.timestamp GROUP BY t.company_id, t.timestamp")
def lb8_arrays(t: Tables):
    ten, frauds = _fraud_inputs(t)
    a = labels.array_labels(ten, labels.spine_frauds(ten, frauds, 120))
    out = a.select("company_id", "timestamp", *labels.horizon_columns())
    return out.select(*[rnd(c, 2).alias(c) if c.startswith("app_fraud_amount") else F.array_join(c, ",").alias(c) if c.startswith("app_fraud_type") else F.col(c)
                        for c in out.columns])


@query("lb14_prediction_history", """SELECT o_custkey AS company_id, CAST(o_orderdate AS DATE) AS evaluation_date, o_totalprice AS prediction FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-05-31'""")
def lb14(t: Tables):
    p = t.orders.select(F.col("o_custkey").alias("company_id"), F.col("o_orderdate").cast("date").alias("evaluation_date"), F.col("o_totalprice").alias("prediction"))
    return transactions.prediction_history(p, date(1998, 3, 1), date(1998, 5, 31))


# ---- random-day against first-day spines ------------------------------------------------------

DAYS = "CAST(m + CAST(((((year(m) * 12 + month(m)) * 31) * 7919 + 7) % 1000003) % day(last_day(m)) AS INT) AS DATE)"


@query("lb10_spine_mode_comparison", f"""WITH {v.MEMBERS}, {v.REPORTS}, months AS (SELECT CAST(unnest(generate_series(date_trunc('month', (SELECT min(o_orderdate) FROM orders)), date_trunc('month', (SELECT max(o_orderdate) FROM orders)), INTERVAL 1 MONTH)) AS DATE) AS m),
cal AS (SELECT 'first' AS mode, m AS d FROM months UNION ALL SELECT 'random', {DAYS} FROM months),
s AS (SELECT mode, company_id, d FROM cal JOIN members ON approved_at < d AND (is_rejected = 0 OR (is_rejected = 1 AND rejected_at > d))),
l AS (SELECT s.mode, s.company_id, s.d, min(r.reported_at) AS f FROM s LEFT JOIN reports r ON s.company_id = r.company_id AND r.reported_at BETWEEN s.d AND s.d + INTERVAL 90 DAY GROUP BY s.mode, s.company_id, s.d)
SELECT mode, count(*) AS n, count(DISTINCT company_id) AS companies, {R('avg(CAST(f IS NOT NULL AS INT))', 6)} AS event_rate, {R('avg(f - d)', 4)} AS mean_days,
  {R('quantile_cont(f - d, 0.5)', 4)} AS median_days FROM l GROUP BY 1""")
def lb10(t: Tables):
    from ..operators import spine
    from ..operators.chunks import attach_totals, exact_quantiles

    first, random = (_calendar(t, m, seed=7).select(F.lit(m).alias("mode"), "feature_date") for m in ("first", "random"))
    days = first.unionByName(random)
    d = labels.member_first_reports(days, v.members(t), v.reports(t), by=["mode"])
    # days from 0 to 90 or none: all that follows is read from these counts
    counts = cut_lineage(d.groupBy("mode", F.datediff("first_report_at", "timestamp").alias("days")).agg(F.count(F.lit(1)).alias("n")))
    hits, total = F.when(F.col("days").isNotNull(), F.col("n")), F.sum("n")
    base = counts.groupBy("mode").agg(total.alias("n"), rnd(F.coalesce(F.sum(hits), F.lit(0)) / total, 6).alias("event_rate"),
                                      rnd(F.try_divide(F.sum(F.col("days") * hits), F.sum(hits)), 4).alias("mean_days"))
    seen = v.members(t).join(F.broadcast(days), spine.is_member_at(F.col("feature_date"))).groupBy("mode").agg(F.countDistinct("company_id").alias("companies"))
    out = attach_totals(base, ["mode"], seen)
    out = attach_totals(out, ["mode"], exact_quantiles(counts, ["mode"], "days", [0.5], ["median_days"], weight="n"))
    return out.select("mode", "n", "companies", "event_rate", "mean_days", rnd("median_days", 4).alias("median_days"))
