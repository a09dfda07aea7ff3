"""Registered queries: rolling account, counterparty, payee and company features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, families
from ..operators.families import SHORT_HOURS
from . import standins as v
from .registry import Tables, query

THRESHOLD = 100.0


def _w(expr: str, window: str, keys: str = "account_id") -> str:
    return (f"{expr} OVER (PARTITION BY {keys} ORDER BY ts RANGE BETWEEN INTERVAL {window} PRECEDING "
            f"AND INTERVAL 1 MICROSECOND PRECEDING)")


def _rounded(df, keep: list[str], digits: int = 4):
    kinds = dict(df.dtypes)
    cols = []
    for c in df.columns:
        if c in keep:
            cols.append(F.col(c))
        elif kinds[c] == "double":
            cols.append(v.rnd(c, digits).alias(c))
        elif kinds[c] == "timestamp":
            cols.append(F.col(c).cast("timestamp_ntz").alias(c))
        elif kinds[c] in ("int", "bigint", "timestamp_ntz"):
            cols.append(F.col(c))
    return df.select(*cols)


ID = ["event_id", "account_id"]
DROP = ["ts", "event_type", "counterparty", "amount", "deposit", "withdrawal"]


@query("rl1_rl2_account_sums", f"WITH {v.PAYMENTS} SELECT event_id, account_id, " + ", ".join(
    f"(round({_w('sum(deposit)', f'{h} HOURS')} + 1e-9, 4) + 0.0) AS deposits_sum_{h}h, (round({_w('sum(withdrawal)', f'{h} HOURS')} + 1e-9, 4) + 0.0) AS withdrawals_sum_{h}h, "
    f"{_w('count(deposit)', f'{h} HOURS')} AS incoming_payments_sum_{h}h, {_w('count(withdrawal)', f'{h} HOURS')} AS outgoing_payments_sum_{h}h"
    for h in SHORT_HOURS) + " FROM payments")
def rl1(t: Tables):
    return _rounded(families.account_sums(v.payments(t)).drop(*DROP), ID)


@query("rl3_account_60d", f"""WITH {v.PAYMENTS} SELECT event_id, account_id,
  {_w('count(deposit)', '60 DAYS')} AS incoming_payments_sum_60days, {_w('count(withdrawal)', '60 DAYS')} AS outgoing_payments_sum_60days,
  (round({_w('avg(deposit)', '60 DAYS')} + 1e-9, 4) + 0.0) AS deposits_mean_60days, {_w('max(deposit)', '60 DAYS')} AS deposits_max_60days,
  (round({_w('stddev_samp(deposit)', '60 DAYS')} + 1e-9, 4) + 0.0) AS stddev_deposits_60days,
  (round({_w('avg(withdrawal)', '60 DAYS')} + 1e-9, 4) + 0.0) AS withdrawals_mean_60days, {_w('max(withdrawal)', '60 DAYS')} AS withdrawals_max_60days,
  (round({_w('stddev_samp(withdrawal)', '60 DAYS')} + 1e-9, 4) + 0.0) AS stddev_withdrawals_60days,
  {_w(f'count(CASE WHEN withdrawal > {THRESHOLD} THEN 1 END)', '60 DAYS')} AS outgoing_payments_over_threshold_sum_60days,
  {_w('max(CASE WHEN withdrawal IS NOT NULL THEN ts END)', '60 DAYS')} AS last_payment_request_max_60days FROM payments""")
def rl3(t: Tables):
    return _rounded(families.account_long(v.payments(t), THRESHOLD).drop(*DROP), ID)


@query("rl3_account_7d", f"""WITH {v.PAYMENTS} SELECT event_id, account_id,
  {_w('count(deposit)', '7 DAYS')} AS incoming_payments_sum_7days, {_w('count(withdrawal)', '7 DAYS')} AS outgoing_payments_sum_7days,
  (round({_w('avg(deposit)', '7 DAYS')} + 1e-9, 4) + 0.0) AS deposits_mean_7days, {_w('max(deposit)', '7 DAYS')} AS deposits_max_7days,
  (round({_w('stddev_samp(deposit)', '7 DAYS')} + 1e-9, 4) + 0.0) AS stddev_deposits_7days,
  (round({_w('avg(withdrawal)', '7 DAYS')} + 1e-9, 4) + 0.0) AS withdrawals_mean_7days, {_w('max(withdrawal)', '7 DAYS')} AS withdrawals_max_7days,
  (round({_w('stddev_samp(withdrawal)', '7 DAYS')} + 1e-9, 4) + 0.0) AS stddev_withdrawals_7days,
  {_w(f'count(CASE WHEN withdrawal > {THRESHOLD} THEN 1 END)', '7 DAYS')} AS outgoing_payments_over_threshold_sum_7days,
  {_w('max(CASE WHEN withdrawal IS NOT NULL THEN ts END)', '7 DAYS')} AS last_payment_request_max_7days FROM payments""")
def rl3_week(t: Tables):
    return _rounded(families.account_long(v.payments(t), THRESHOLD, days=7).drop(*DROP), ID)


@query("rl4_tester_payments", f"WITH {v.PAYMENTS} SELECT event_id, account_id, {_w('count(CASE WHEN amount <= 5 THEN 1 END)', '24 HOURS')} AS tester_payments_sum_24h FROM payments")
def rl4(t: Tables):
    return families.tester_payments(v.payments(t), 5.0).drop(*DROP)


def _cp_sql(flow: str, name: str, count: str) -> str:
    cols = []
    for tag, win in (("2h", "2 HOURS"), ("48h", "48 HOURS"), ("60days", "60 DAYS")):
        for a, fn in (("sum", "sum"), ("mean", "avg"), ("max", "max"), ("min", "min")):
            expr = _w(f"{fn}({flow})", win, "account_id, counterparty")
            cols.append(f"(round({expr} + 1e-9, 4) + 0.0) AS {name}_{a}_{tag}")
        cols.append(_w(f"count({flow})", win, "account_id, counterparty") + f" AS {count}_sum_{tag}")
    return f"WITH {v.PAYMENTS} SELECT event_id, account_id, {', '.join(cols)} FROM payments"


@query("rl5_to_counterparty", _cp_sql("withdrawal", "withdrawals_to_cp", "payments_to_cp"))
def rl5(t: Tables):
    return _rounded(families.counterparty_features(v.payments(t), "withdrawal").drop(*DROP), ID)


@query("rl6_from_counterparty", _cp_sql("deposit", "deposits_from_cp", "payments_from_cp"))
def rl6(t: Tables):
    return _rounded(families.counterparty_features(v.payments(t), "deposit").drop(*DROP), ID)


def _over_sql() -> str:
    cols = []
    for tag, win in (("2h", "2 HOURS"), ("48h", "48 HOURS"), ("60days", "60 DAYS")):
        for f, way in (("withdrawal", "to"), ("deposit", "from")):
            case = f"CASE WHEN {f} > {THRESHOLD} THEN {f} END"
            cols.append(_w(f"count({case})", win, "account_id, counterparty") + f" AS sum_payments_{way}_cp_over_threshold_{tag}")
            cols.append("(round(" + _w(f"sum({case})", win, "account_id, counterparty") + f" + 1e-9, 4) + 0.0) AS sum_payments_value_{way}_cp_over_threshold_{tag}")
    cols.append(_w(f"max(CASE WHEN withdrawal > {THRESHOLD} THEN ts END)", "60 DAYS", "account_id, counterparty") + " AS last_payment_request_timestamp_over_threshold")
    return f"WITH {v.PAYMENTS} SELECT event_id, account_id, {', '.join(cols)} FROM payments"


@query("rl7_over_threshold", _over_sql())
def rl7(t: Tables):
    return _rounded(families.over_threshold_features(v.payments(t), THRESHOLD).drop(*DROP), ID)


@query("rl8_payee_recency", f"""WITH {v.PAYMENTS}, s AS (SELECT event_id, account_id, counterparty, ts FROM payments WHERE event_type = 'purchase'),
u AS (SELECT account_id, counterparty, ts AS updated_at FROM payments WHERE event_type IN ('view', 'click')),
c AS (SELECT account_id, counterparty, ts AS confirmed_at FROM payments WHERE event_type = 'signup')
SELECT s.event_id, s.account_id, s.counterparty, u.updated_at AS last_updated_at, c.confirmed_at AS confirmed_timestamp FROM s
ASOF LEFT JOIN u ON s.account_id = u.account_id AND s.counterparty = u.counterparty AND s.ts >= u.updated_at
ASOF LEFT JOIN c ON s.account_id = c.account_id AND s.counterparty = c.counterparty AND s.ts >= c.confirmed_at""")
def rl8(t: Tables):
    p = v.payments(t).withColumn("pair", F.struct("account_id", "counterparty"))
    s = p.where("event_type = 'purchase'").select("event_id", "pair", "ts")
    f = p.where(F.col("event_type").isin("view", "click", "signup")).select(
        "pair", F.col("ts").alias("feature_ts"),
        F.when(F.col("event_type") != "signup", F.col("ts")).alias("updated"),
        F.when(F.col("event_type") == "signup", F.col("ts")).alias("confirmed"))
    a = asof.asof_join(s, f.where("updated is not null").select("pair", F.col("updated").alias("last_updated_at")), "pair", "ts", "last_updated_at", [])
    b = asof.asof_join(a, f.where("confirmed is not null").select("pair", F.col("confirmed").alias("confirmed_timestamp")), "pair", "ts", "confirmed_timestamp", [])
    return b.select("event_id", "pair.account_id", "pair.counterparty", "last_updated_at", "confirmed_timestamp")


FIRSTS = """firsts AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY account_id, counterparty ORDER BY ts, event_id) = 1 THEN 1 END AS is_first FROM payments)"""


@query("rl9_payee_popularity", f"""WITH {v.PAYMENTS}, {FIRSTS} SELECT event_id, account_id,
  count(is_first) OVER w AS accounts_with_same_payee, min(CASE WHEN is_first = 1 THEN ts END) OVER w AS first_time_payee_addition,
  max(CASE WHEN is_first = 1 THEN ts END) OVER w AS last_time_payee_addition FROM firsts
WINDOW w AS (PARTITION BY counterparty ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def rl9(t: Tables):
    return families.payee_popularity(v.payments(t)).drop(*DROP)


@query("rl10_recency", f"""WITH {v.PAYMENTS} SELECT event_id, account_id,
  {_w(f'count(CASE WHEN withdrawal > {THRESHOLD} THEN 1 END)', '48 HOURS')} AS outgoing_payments_over_threshold_sum_2d,
  {_w('max(CASE WHEN withdrawal IS NOT NULL THEN hour(ts) END)', '48 HOURS')} AS payment_initiated_hour_max_48h,
  {_w('min(CASE WHEN withdrawal IS NOT NULL THEN hour(ts) END)', '48 HOURS')} AS payment_initiated_hour_min_48h,
  {_w('count(CASE WHEN withdrawal IS NOT NULL AND hour(ts) NOT BETWEEN 9 AND 21 THEN 1 END)', '60 DAYS')} AS payments_outside_9_to_22h_60d,
  {_w('count(CASE WHEN withdrawal IS NOT NULL AND hour(ts) BETWEEN 9 AND 21 THEN 1 END)', '60 DAYS')} AS payments_inside_9_to_22h_60d,
  {_w(f'count(CASE WHEN withdrawal > {THRESHOLD} THEN 1 END)', '60 DAYS')} AS outgoing_payments_over_threshold_sum_60d FROM payments""")
def rl10(t: Tables):
    return families.recency_features(v.payments(t), THRESHOLD).drop(*DROP)


@query("rl11_new_payees", f"""WITH {v.PAYMENTS}, {FIRSTS} SELECT event_id, account_id,
  {_w('count(is_first)', '30 MINUTES')} AS new_payee_count_30mins, {_w('count(is_first)', '2 HOURS')} AS new_payee_count_2h,
  {_w('count(is_first)', '48 HOURS')} AS new_payee_count_48h FROM firsts""")
def rl11(t: Tables):
    return families.new_payee_counts(v.payments(t)).drop(*DROP)


CHANNELS = {"card": "view", "cardwtd": "error", "fast_out": "purchase", "ddebit": "error", "out": "view",
            "fast_in": "signup", "cash": "click", "in": "signup"}


@query("rl12_company_behaviour", f"""WITH {v.PAYMENTS}, sp AS (
  SELECT account_id, d AS spine_ts FROM (SELECT DISTINCT account_id FROM payments),
    (SELECT unnest([TIMESTAMP '2024-01-12', TIMESTAMP '2024-01-22', TIMESTAMP '2024-02-01']) AS d)),
h AS (SELECT sp.account_id, sp.spine_ts, p.* EXCLUDE (account_id), deposit IS NOT NULL AS dep FROM sp JOIN payments p
  ON sp.account_id = p.account_id AND p.ts > sp.spine_ts - INTERVAL 365 DAY AND p.ts < sp.spine_ts),
g AS (SELECT account_id, spine_ts, (round(avg(deposit) + 1e-9, 4) + 0.0) AS avg_deposit, max(deposit) AS max_deposit,
  (round(avg(withdrawal) + 1e-9, 4) + 0.0) AS avg_withdrawal, max(withdrawal) AS max_withdrawal,
  (round(avg(CASE WHEN amount % 10 = 0 THEN 1 ELSE 0 END) + 1e-9, 6) + 0.0) AS pct_round_txns,
  (round(count(DISTINCT amount) / count(amount) + 1e-9, 6) + 0.0) AS pct_unique_txns,
  count(CASE WHEN amount <= 5 THEN 1 END) AS tester_pmt_cnt,
  count(CASE WHEN event_type = 'click' AND (hour(ts) < 6 OR hour(ts) >= 22) THEN 1 END) AS cashtxns_latehrs,
  {", ".join(f"(round(count(CASE WHEN event_type = '{CHANNELS[r]}' AND NOT dep THEN 1 END) / nullif(count(CASE WHEN NOT dep THEN 1 END), 0) + 1e-9, 6) + 0.0) AS {n}_wtd_pct"
             for n, r in (("cardpmt", "card"), ("fastpmt", "fast_out"), ("ddebit", "ddebit"), ("cardwtd", "cardwtd"), ("outpmt", "out")))},
  {", ".join(f"(round(count(CASE WHEN event_type = '{CHANNELS[r]}' AND dep THEN 1 END) / nullif(count(CASE WHEN dep THEN 1 END), 0) + 1e-9, 6) + 0.0) AS {n}_dep_pct"
             for n, r in (("fastpmt", "fast_in"), ("cash", "cash"), ("inpmt", "in")))},
  {", ".join(f"count(DISTINCT CASE WHEN event_type IN ({', '.join(repr(CHANNELS[x]) for x in r)}) THEN counterparty END) AS {n}"
             for n, r in (("fastpmt_beneficiaries", ["fast_out"]), ("fastpmt_benefactors", ["fast_in"]), ("ddebit_beneficiaries", ["ddebit"]),
                          ("cardpmt_acceptors", ["card"]), ("pos_atm_locations", ["cardwtd"]), ("card_pans_cnt", ["card", "cardwtd"])))},
  (round(count(CASE WHEN dep THEN 1 END) / nullif(count(CASE WHEN NOT dep THEN 1 END), 0) + 1e-9, 6) + 0.0) AS deposit_wtd_frequency_ratio,
  {", ".join(f"count(CASE WHEN event_type = '{CHANNELS[r]}' AND amount > 100 THEN 1 END) AS {n}"
             for n, r in (("high_card_pmts", "card"), ("high_card_wtds", "cardwtd"), ("high_fpmt_out", "fast_out"), ("high_pmt_out", "out"),
                          ("high_ddebit", "ddebit"), ("high_fpmt_in", "fast_in"), ("high_pmt_in", "in"), ("max_cash_deposits", "cash")))},
  count(CASE WHEN event_type LIKE '%view%' THEN 1 END) AS name_match_cnt
  FROM h GROUP BY 1, 2)
SELECT * FROM sp LEFT JOIN g USING (account_id, spine_ts)""")
def rl12(t: Tables):
    p = v.payments(t).withColumnRenamed("ts", "txn_ts")
    dates = F.array(*[F.to_timestamp_ntz(F.lit(f"2024-{d} 00:00:00")) for d in ("01-12", "01-22", "02-01")])
    spine = p.select("account_id").distinct().withColumn("spine_ts", F.explode(dates))
    ms = families.company_behaviour_measures("event_type", "amount", "counterparty", "txn_ts",
                                             F.col("deposit").isNotNull(), CHANNELS, 100.0, tester=5.0)
    ms.append(F.count_if(F.col("event_type").contains("view")).alias("name_match_cnt"))
    out = families.company_behaviour(spine, p, "account_id", "spine_ts", "txn_ts", ms)
    digits = {c: 4 for c in ("avg_deposit", "avg_withdrawal")}
    return out.select(*[v.rnd(c, digits.get(c, 6)).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


@query("rl13_latest_state", f"""WITH {v.PAYMENTS}, s AS (SELECT event_id, account_id, ts FROM payments WHERE event_type = 'purchase'),
st AS (SELECT account_id, ts AS state_ts, CAST(counterparty % 2 = 0 AS INT) AS is_clearlisted, amount AS clearlisted_amount, ts + INTERVAL 5 DAY AS expiry_ts
  FROM payments WHERE event_type = 'signup')
SELECT s.event_id, s.account_id, st.state_ts, coalesce(st.is_clearlisted, 0) AS is_clearlisted, st.clearlisted_amount,
  CASE WHEN st.expiry_ts > s.ts THEN 1 ELSE 0 END AS still_valid
FROM s ASOF LEFT JOIN st ON s.account_id = st.account_id AND s.ts >= st.state_ts""")
def rl13(t: Tables):
    p = v.payments(t)
    s = p.where("event_type = 'purchase'").select("event_id", "account_id", "ts")
    st = p.where("event_type = 'signup'").select(
        "account_id", F.col("ts").alias("state_ts"), (F.col("counterparty") % 2 == 0).cast("int").alias("is_clearlisted"),
        F.col("amount").alias("clearlisted_amount"), (F.col("ts") + F.expr("interval 5 days")).alias("expiry_ts"))
    j = asof.asof_join(s, st, "account_id", "ts", "state_ts", ["is_clearlisted", "clearlisted_amount", "expiry_ts"])
    return j.select("event_id", "account_id", "state_ts", F.coalesce("is_clearlisted", F.lit(0)).alias("is_clearlisted"),
                    "clearlisted_amount", F.coalesce((F.col("expiry_ts") > F.col("ts")).cast("int"), F.lit(0)).alias("still_valid"))


@query("rl14_last_20", f"""WITH {v.PAYMENTS}, n AS (SELECT event_id, account_id, withdrawal, ts,
  row_number() OVER (PARTITION BY account_id ORDER BY ts, event_id) AS rn FROM payments WHERE withdrawal IS NOT NULL),
w AS (SELECT *, count(*) OVER w AS n_last, avg(withdrawal) OVER w AS m, stddev_samp(withdrawal) OVER w AS s,
  regr_slope(withdrawal, CAST(rn AS DOUBLE)) OVER w AS slope, min(ts) OVER w AS p0, max(ts) OVER w AS p1 FROM n
  WINDOW w AS (PARTITION BY account_id ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT event_id, account_id, n_last, (round(m + 1e-9, 4) + 0.0) AS mean_last, (round(s + 1e-9, 4) + 0.0) AS std_last, (round(slope + 1e-9, 4) + 0.0) AS trend_last,
  (round((withdrawal - m) / nullif(s, 0) + 1e-9, 4) + 0.0) AS zscore_last,
  (round((epoch_us(p1) - epoch_us(p0)) / 1e6 / nullif(n_last - 1, 0) + 1e-9, 3) + 0.0) AS mean_gap_seconds_last,
  (round(n_last * m / nullif((epoch_us(p1) - epoch_us(p0)) / 1e6 / 3600, 0) + 1e-9, 4) + 0.0) AS velocity_last FROM w""")
def rl14(t: Tables):
    out = families.last_n_statistics(v.payments(t), "withdrawal")
    return out.select("event_id", "account_id", "n_last", *[v.rnd(c, 4).alias(c) for c in ("mean_last", "std_last", "trend_last", "zscore_last", "velocity_last")],
                      v.rnd("mean_gap_seconds_last", 3).alias("mean_gap_seconds_last"))


@query("wn8_mean_gap", """SELECT user_id, (round(avg(gap) + 1e-9, 4) + 0.0) AS mean_gap_seconds FROM (
  SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 AS gap FROM events) GROUP BY 1""")
def wn8(t: Tables):
    return families.mean_gap_seconds(t.events, ["user_id"], "ts").withColumn("mean_gap_seconds", v.rnd("mean_gap_seconds", 4))
