"""Registered queries: payment-level derived features, rules and the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode, payment, rules
from ..operators.payment import DEPOSIT_CHANNELS, FILL_ONE, HIGH_VALUE_COUNTS, WITHDRAWAL_CHANNELS, fill_zero_columns
from ..sources.names import HOURS
from .registry import Tables, query
from .standins import R, rnd

# Payment requests stand-in: one request per line item, inputs by expression, a quarter null.
T0 = 1_700_000_000
INPUT = {"row_id": "l_orderkey * 10 + l_linenumber", "requested_payment_value": "CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_extendedprice / 100 END",
         "rule_feature_request_timestamp": f"{T0} + l_orderkey * 60"}
for _i, _n in enumerate([*FILL_ONE, *fill_zero_columns()]):
    _sign = "-" if "withdrawal" in _n and "counter" not in _n and "number" not in _n and "percentage" not in _n else ""
    INPUT[_n] = f"CASE WHEN (l_linenumber + l_suppkey + {_i}) % 4 <> 0 AND l_linenumber < 6 THEN {_sign}(l_quantity * {1 + _i % 7} + l_linenumber * {_i % 5}) END"
INPUT |= {
    "timestamp_ntm_recipient_confirmed": f"CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN {T0} + l_orderkey * 60 - 3600 WHEN 3 THEN {T0} + l_orderkey * 60 - 100000 ELSE {T0} + l_orderkey * 60 - 40000000 END",
    "last_payment_requested_received_at_60d": f"CASE WHEN l_suppkey % 4 <> 0 THEN {T0} + l_orderkey * 60 - l_suppkey * l_linenumber * 4321 END",
    "number_of_fastpayment_beneficiaries_1y": "l_linenumber % 4", "number_of_fastpayment_benefactors_1y": "l_suppkey % 3",
    "member_postcode": "CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN 'SW1A' WHEN 1 THEN 'B33 8TH' WHEN 2 THEN 'QQ1' END", "member_id_country_issue": "CASE WHEN l_suppkey % 3 = 0 THEN 'GB' WHEN l_suppkey % 3 = 1 THEN 'FRA' END",
    "member_id_type": "CASE WHEN l_suppkey % 2 = 0 THEN 'Driving_License' ELSE 'Passport' END", "registered_company_type": "CASE WHEN l_suppkey % 2 = 0 THEN 'Private-Limited-Guarant-NSC' WHEN l_suppkey % 3 = 0 THEN 'LTD' END",
    "is_registered_company": "CASE WHEN l_suppkey % 6 <> 0 THEN l_suppkey % 2 END", "member_age_at_onboarding": "CASE WHEN l_suppkey % 7 <> 0 THEN 18 + l_suppkey % 40 END",
    "deposit_withdrawal_frequency_ratio_1y": "CASE WHEN l_suppkey % 9 <> 0 THEN l_quantity / 10 END",
    "destination_account_number": "CASE WHEN l_suppkey % 10 = 0 THEN '12001039' WHEN l_suppkey % 10 = 1 THEN '00331708' WHEN l_suppkey % 10 = 2 THEN NULL ELSE '87654321' END",
    "destination_account_sort_code": "CASE WHEN l_suppkey % 10 = 0 THEN '083210' WHEN l_suppkey % 10 = 1 THEN '300001' ELSE '083200' END",
    "rule_feature_kyc_risk_band": "CASE WHEN l_suppkey % 3 = 0 THEN 'low' END", "rule_feature_is_clearlisted": "CAST(NULL AS BOOLEAN)", "rule_feature_event_ignore_expiration": "CAST(NULL AS BOOLEAN)",
    "rule_feature_clearlisting_last_updated_at": "CASE WHEN l_suppkey % 3 = 0 THEN 'bad' END",
    "rule_feature_permenant_clearlisting_last_whitelisted_at": f"CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN '{T0 + 50000}' WHEN 1 THEN 'bad' WHEN 2 THEN '{T0 + 30_000_000}' END",
    "rule_feature_is_source_dest_clearlisted": "CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey % 3 = 1 END",
    "rule_feature_source_dest_expiry_ts": f"{T0} + l_orderkey * 60 + l_linenumber - 3", "rule_feature_source_dest_amount": "l_extendedprice / 100 + l_linenumber - 4",
    "rule_feature_credit_line_amount": "CASE WHEN l_suppkey % 5 <> 0 THEN l_extendedprice / 100 + l_linenumber - 3 END",
    "rule_feature_credit_line_last_updated_at": f"CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE {T0} + l_orderkey * 60 - 28 - l_linenumber END",
}
REQ_SQL = "req AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in INPUT.items()) + " FROM lineitem)"
FILLED = {**{n: 1 for n in FILL_ONE}, **{n: 0 for n in fill_zero_columns()}}
SECONDS = "CASE WHEN timestamp_ntm_recipient_confirmed IS NULL OR timestamp_ntm_recipient_confirmed = 0 THEN 31536000 ELSE rule_feature_request_timestamp - timestamp_ntm_recipient_confirmed END"
F_SQL = (f"{REQ_SQL}, f AS (SELECT * REPLACE (" + ", ".join(f"coalesce({n}, {d}) AS {n}" for n, d in FILLED.items())
         + f"), {SECONDS} AS s FROM req)")
REQV = "requested_payment_value"


def _requests(t: Tables):
    return t.lineitem.select(*[F.expr(e).alias(n) for n, e in INPUT.items()])


def _features(t: Tables):
    return payment.preprocess(_requests(t))


def _acc(flow: str, h: int) -> str:
    return f"rolling_sum_of_{flow}_on_account_{h}h"


def _guarded(parts: list[str]) -> str:
    return "CASE WHEN " + " AND ".join(f"({p}) IS NOT NULL" for p in parts) + f" THEN greatest({', '.join(parts)}) END"


BAL = [f"(abs({_acc('withdrawals', h)}) + {REQV} - abs({_acc('deposits', h)})) / nullif(abs({_acc('withdrawals', h)}) + {REQV} + abs({_acc('deposits', h)}), 0)" for h in HOURS]
RAT = [f"({_acc('outgoing_payments', h)} + 1 - {_acc('incoming_payments', h)}) / nullif({_acc('outgoing_payments', h)} + 1 + {_acc('incoming_payments', h)}, 0)" for h in HOURS]
BALANCE_SQL = {
    "net_balance_indicator": _guarded(BAL), "cashflow_value_indicator": "greatest(" + ", ".join(f"{_acc('deposits', h)} + abs({_acc('withdrawals', h)}) + {REQV}" for h in HOURS) + ")",
    "deposit_withdrawal_ratio": _guarded(RAT), "cashflow_volume_indicator": "greatest(" + ", ".join(f"{_acc('outgoing_payments', h)} + {_acc('incoming_payments', h)} + 1" for h in HOURS) + ")"}
RATIO_SQL = {}
for _kind, _fn in (("withdrawal", "abs({})"), ("deposit", "{}")):
    for _word, _col, _span in (("mean", "average", "60d"), ("max", "max", "60d"), ("average", "average", "1y"), ("max", "max", "1y")):
        RATIO_SQL[f"payment_requested_{_word}_{_kind}_ratio_{_span}"] = f"{REQV} / nullif({REQV} + {_fn.format(f'{_col}_{_kind}_value_{_span}')}, 0)"


def _argmax_sql(channels: dict[str, str]) -> str:
    top = f"greatest({', '.join(channels)})"
    return "CASE " + " ".join(f"WHEN {c} = {top} THEN '{n}'" for c, n in channels.items()) + " END"


CP = "rolling_{}_of_{}_{}_counter_party_{}"
OVER = "rolling_sum_of_withdrawals_value_to_counter_party_abv_thresh_1000_{}"
W60 = "average_withdrawal_value_60d * outgoing_payments_sum_account_60d"
IN2, IN60 = _acc("incoming_payments", 2), "incoming_payments_sum_account_60d"
DERIVED_SQL = {
    "payments_initiated_hour_48h_range": "payment_initiated_hour_max_48h - payment_initiated_hour_min_48h",
    "ratio_pmts_outside_business_60d": "number_of_payments_outside_9am_to_10pm_60d / nullif(outgoing_payments_sum_account_60d + 1, 0)",
    "days_since_confirmation_of_payee": "least(s / 86400, 365)", "hours_since_confirmation_of_payee": "least(s / 3600, 48)",
    "incoming_payment_requested_avg_pmt_value_with_payee_ratio_60d": f"{REQV} / nullif({CP.format('mean', 'deposits', 'from', '60d')} + 1, 0)",
    "outgoing_payment_requested_avg_pmt_value_with_payee_ratio_60d": f"{REQV} / nullif({CP.format('mean', 'withdrawals', 'to', '60d')} + 1, 0)",
    "mean_of_payments_to_new_payees_60d": f"CASE WHEN s < 3600 THEN {CP.format('mean', 'withdrawals', 'to', '60d')} ELSE 0 END",
    "sum_of_payments_to_new_payees_48h": f"CASE WHEN s < 172800 THEN {CP.format('sum', 'withdrawals', 'to', '48h')} ELSE 0 END",
    "rolling_sum_of_pmts_over_threshold_to_new_payee_48h": f"CASE WHEN s < 172800 THEN {OVER.format('48h')} ELSE 0 END",
    "rolling_sum_of_pmts_over_threshold_to_new_payee_60d": f"CASE WHEN s < 172800 THEN {OVER.format('60d')} ELSE 0 END",
    "ratio_of_pmts_value_to_payee_of_overall_pmts_2h": f"{CP.format('sum', 'withdrawals', 'to', '2h')} / nullif({_acc('withdrawals', 2)} + 1, 0)",
    "ratio_of_pmts_value_to_payee_of_overall_pmts_48h": f"{CP.format('sum', 'withdrawals', 'to', '48h')} / nullif({_acc('withdrawals', 48)} + 1, 0)",
    "ratio_of_pmts_value_to_payee_of_overall_pmts_60d": f"{CP.format('sum', 'withdrawals', 'to', '60d')} / nullif({W60} + 1, 0)",
    "incoming_payment_density_over_the_past_2h_vs_60days": f"({IN60} - {IN2}) * {IN2}",
    "incoming_payment_density_over_the_past_2h_vs_60days_ratio": f"({IN60} - {IN2}) / nullif({IN60} + 1, 0)",
    "ratio_of_rolling_sum_of_wtd_2h_to_max_wtd_60d": f"(max_withdrawal_value_60d - {_acc('withdrawals', 2)}) / nullif(max_withdrawal_value_60d + 1, 0)",
    "ratio_of_rolling_sum_of_deposits_2h_to_max_deposit_60d": f"(max_deposit_value_60d - {_acc('deposits', 2)}) / nullif(max_deposit_value_60d + 1, 0)",
    "count_above_thr_deposite_from_counter_party_1000_60d": "rolling_sum_of_deposits_value_to_counter_party_abv_thresh_1000_60d",
    "avg_no_payment_to_from_counter_party": "(rolling_count_of_payments_from_counter_party_48h + rolling_count_of_payments_to_counter_party_48h) / 2",
    "payment_transfer_rate_on_cop": f"CASE WHEN {REQV} > 0 THEN ln({REQV} / (s + 1)) END",
    "requested_payment_to_avg_deposit_60d_ratio": f"{REQV} / nullif(average_deposit_value_60d + 1, 0)",
    "is_requested_payment_gt_60day_max_wtd": f"CASE WHEN {REQV} > max_withdrawal_value_60d THEN 1 ELSE 0 END",
}
RECENCY_SQL = {
    "number_of_days_since_last_withdrawal_60d": "CASE WHEN last_payment_requested_received_at_60d IS NOT NULL THEN least(greatest(round_even((rule_feature_request_timestamp - last_payment_requested_received_at_60d) / 86400.0, 0), 0), 60) END",
    "is_previous_payment_in_last_15mins": "CASE WHEN (rule_feature_request_timestamp - last_payment_requested_received_at_60d) / 60.0 < 15 THEN 1 ELSE 0 END",
    "fastpmt_beneficiaries_benefactors_ratio_1y": "number_of_fastpayment_beneficiaries_1y / nullif(number_of_fastpayment_beneficiaries_1y + number_of_fastpayment_benefactors_1y, 0)",
    "time_passed_since_confirmation_of_payee": "s"}


def _sql(cols: dict[str, str], extra: str = "") -> str:
    return f"WITH {F_SQL} SELECT row_id, " + ", ".join(f"{R(f'({e})', 6)} AS {n}" for n, e in cols.items()) + extra + " FROM f"


def _pick(df, cols):
    return df.select("row_id", *[rnd(F.col(c).cast("double"), 6).alias(c) for c in cols])


@query("gp1_gp4_balance", _sql(BALANCE_SQL), wide=True)
def gp1(t: Tables):
    return _pick(_features(t), BALANCE_SQL)


@query("gp5_requested_ratios", _sql(RATIO_SQL), wide=True)
def gp5(t: Tables):
    return _pick(_features(t), RATIO_SQL)


@query("gp6_gp8_channels", f"WITH {F_SQL} SELECT row_id, {_argmax_sql(WITHDRAWAL_CHANNELS)} AS w_channel, {_argmax_sql(DEPOSIT_CHANNELS)} AS d_channel, {R(' + '.join(HIGH_VALUE_COUNTS), 4)} AS high_value FROM f", wide=True)
def gp6(t: Tables):
    return _features(t).select("row_id", F.col("payment_channel_most_used_for_withdrawals").alias("w_channel"), F.col("payment_channel_most_used_for_deposits").alias("d_channel"),
                               rnd("number_of_high_value_transactions_1y", 4).alias("high_value"))


@query("gp9_gp12_recency", _sql(RECENCY_SQL), wide=True)
def gp9(t: Tables):
    return _pick(_features(t), RECENCY_SQL)


@query("gp13_gp26_ratios", _sql(DERIVED_SQL), wide=True)
def gp13(t: Tables):
    return _pick(_features(t), DERIVED_SQL)


RULES_SQL = f"""CASE WHEN coalesce(destination_account_number, '') || coalesce(destination_account_sort_code, '') IN ({', '.join(f"'{c}'" for c in rules.EXEMPTED)}) THEN 1 ELSE 0 END AS exempted,
  CASE WHEN rule_feature_request_timestamp > TRY_CAST(rule_feature_permenant_clearlisting_last_whitelisted_at AS BIGINT) AND TRY_CAST(rule_feature_permenant_clearlisting_last_whitelisted_at AS BIGINT) > 0 THEN 1 ELSE 0 END AS clearlisted,
  CASE WHEN rule_feature_is_source_dest_clearlisted AND rule_feature_request_timestamp < rule_feature_source_dest_expiry_ts AND {REQV} <= rule_feature_source_dest_amount THEN 1 ELSE 0 END AS pair_clearlisted,
  CASE WHEN rule_feature_credit_line_amount > 0 AND rule_feature_credit_line_last_updated_at > 0 AND {REQV} <= rule_feature_credit_line_amount
    AND rule_feature_request_timestamp - rule_feature_credit_line_last_updated_at < 30 THEN 1 ELSE 0 END AS credit_event"""


@query("gp27_gp31_rules", f"WITH {REQ_SQL} SELECT row_id, {RULES_SQL}, upper(coalesce(rule_feature_kyc_risk_band, 'HIGH')) AS band FROM req")
def gp27(t: Tables):
    r = rules.apply_rules(_requests(t))
    return r.select("row_id", F.col("rule_feature_is_recipient_account_exempted").alias("exempted"), F.col("rule_feature_is_clearlisted").alias("clearlisted"),
                    F.col("rule_feature_is_source_dest_clearlisted").alias("pair_clearlisted"), F.col("rule_feature_is_matching_credit_event").alias("credit_event"),
                    F.col("rule_feature_kyc_risk_band").alias("band"))


CHAIN = ["net_balance_indicator", "deposit_withdrawal_ratio", "payment_transfer_rate_on_cop", "number_of_days_since_last_withdrawal_60d", "fastpmt_beneficiaries_benefactors_ratio_1y", "is_registered_company"]
CHAIN_SQL = BALANCE_SQL | DERIVED_SQL | RECENCY_SQL | {"is_registered_company": "is_registered_company"}
AREA = "CASE member_postcode WHEN 'SW1A' THEN 'SW' WHEN 'B33 8TH' THEN 'B' END"


@query("gp32_ft1_ft2_chain", f"""WITH {F_SQL}, med AS (SELECT quantile_cont(member_age_at_onboarding, 0.5) AS m1, quantile_cont(deposit_withdrawal_frequency_ratio_1y, 0.5) AS m2 FROM req)
SELECT row_id, {', '.join(f'{R(f"coalesce(({CHAIN_SQL[c]}), {payment.IMPUTE_CONSTANTS[c]})", 6)} AS {c}' for c in CHAIN)}, {R('coalesce(member_age_at_onboarding, m1)', 6)} AS member_age_at_onboarding,
  {R('coalesce(deposit_withdrawal_frequency_ratio_1y, m2)', 6)} AS deposit_withdrawal_frequency_ratio_1y, upper(coalesce({AREA}, 'missing')) AS member_area_code,
  upper(coalesce(CASE WHEN member_id_country_issue = 'GB' THEN 'GBR' ELSE member_id_country_issue END, 'missing')) AS member_id_country_issue,
  CASE WHEN member_id_type = 'Passport' THEN 'PASSPORT' ELSE 'DRIVING_LICENCE' END AS member_id_type,
  CASE registered_company_type WHEN 'LTD' THEN 'LTD' WHEN 'Private-Limited-Guarant-NSC' THEN 'PRIVATE_LIMITED_GUARANT_NSC' ELSE 'MISSING' END AS registered_company_type,
  upper(coalesce({_argmax_sql(DEPOSIT_CHANNELS)}, 'fast_payment')) AS d_channel FROM f, med""", wide=True)
def gp32(t: Tables):
    x = _features(t)
    model = encode.fit_imputer(x, {c: payment.IMPUTE_CONSTANTS[c] for c in payment.IMPUTE_CONSTANTS if c in x.columns}, list(payment.IMPUTE_MEDIANS))
    y = model.transform(x)
    texts = ["member_area_code", "member_id_country_issue", "member_id_type", "registered_company_type"]
    return y.select("row_id", *[rnd(F.col(c).cast("double"), 6).alias(c) for c in CHAIN + ["member_age_at_onboarding", "deposit_withdrawal_frequency_ratio_1y"]],
                    *[F.upper(c).alias(c) for c in texts], F.upper("payment_channel_most_used_for_deposits").alias("d_channel"))
