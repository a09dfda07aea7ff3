"""Payment-level derived features: every one a column expression, usable in batch and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.names import HOURS
from .prefix import area_code
from .timekeys import DAY

HOUR, YEAR_SECONDS = 3600, 365 * DAY
REQ = "requested_payment_value"

# Columns filled with one or zero before the ratios are taken.
FILL_ONE = (
    "incoming_payments_sum_account_60d", "max_withdrawal_value_60d", "average_deposit_value_60d",
    "max_deposit_value_60d", "stddev_deposits_in_60d", "stddev_withdrawals_in_60d", "outgoing_payments_sum_account_60d",
)


# Columns filled with zero before the ratios: account, counterparty and one-year measures.
FILL_ZERO = (
    "rolling_sum_of_deposits_on_account_2h",
    "rolling_sum_of_deposits_on_account_4h",
    "rolling_sum_of_deposits_on_account_8h",
    "rolling_sum_of_deposits_on_account_12h",
    "rolling_sum_of_deposits_on_account_24h",
    "rolling_sum_of_deposits_on_account_48h",
    "rolling_sum_of_withdrawals_on_account_2h",
    "rolling_sum_of_withdrawals_on_account_4h",
    "rolling_sum_of_withdrawals_on_account_8h",
    "rolling_sum_of_withdrawals_on_account_12h",
    "rolling_sum_of_withdrawals_on_account_24h",
    "rolling_sum_of_withdrawals_on_account_48h",
    "rolling_sum_of_incoming_payments_on_account_2h",
    "rolling_sum_of_incoming_payments_on_account_4h",
    "rolling_sum_of_incoming_payments_on_account_8h",
    "rolling_sum_of_incoming_payments_on_account_12h",
    "rolling_sum_of_incoming_payments_on_account_24h",
    "rolling_sum_of_incoming_payments_on_account_48h",
    "rolling_sum_of_outgoing_payments_on_account_2h",
    "rolling_sum_of_outgoing_payments_on_account_4h",
    "rolling_sum_of_outgoing_payments_on_account_8h",
    "rolling_sum_of_outgoing_payments_on_account_12h",
    "rolling_sum_of_outgoing_payments_on_account_24h",
    "rolling_sum_of_outgoing_payments_on_account_48h",
    "rolling_sum_of_withdrawals_to_counter_party_2h",
    "rolling_mean_of_withdrawals_to_counter_party_2h",
    "rolling_max_of_withdrawals_to_counter_party_2h",
    "rolling_min_of_withdrawals_to_counter_party_2h",
    "rolling_count_of_payments_to_counter_party_2h",
    "rolling_sum_of_withdrawals_to_counter_party_abv_thresh_1000_2h",
    "rolling_sum_of_withdrawals_value_to_counter_party_abv_thresh_1000_2h",
    "rolling_sum_of_deposits_from_counter_party_2h",
    "rolling_mean_of_deposits_from_counter_party_2h",
    "rolling_max_of_deposits_from_counter_party_2h",
    "rolling_min_of_deposits_from_counter_party_2h",
    "rolling_count_of_payments_from_counter_party_2h",
    "rolling_sum_of_deposits_to_counter_party_abv_thresh_1000_2h",
    "rolling_sum_of_deposits_value_to_counter_party_abv_thresh_1000_2h",
    "rolling_sum_of_withdrawals_to_counter_party_48h",
    "rolling_mean_of_withdrawals_to_counter_party_48h",
    "rolling_max_of_withdrawals_to_counter_party_48h",
    "rolling_min_of_withdrawals_to_counter_party_48h",
    "rolling_count_of_payments_to_counter_party_48h",
    "rolling_sum_of_withdrawals_to_counter_party_abv_thresh_1000_48h",
    "rolling_sum_of_withdrawals_value_to_counter_party_abv_thresh_1000_48h",
    "rolling_sum_of_deposits_from_counter_party_48h",
    "rolling_mean_of_deposits_from_counter_party_48h",
    "rolling_max_of_deposits_from_counter_party_48h",
    "rolling_min_of_deposits_from_counter_party_48h",
    "rolling_count_of_payments_from_counter_party_48h",
    "rolling_sum_of_deposits_to_counter_party_abv_thresh_1000_48h",
    "rolling_sum_of_deposits_value_to_counter_party_abv_thresh_1000_48h",
    "rolling_sum_of_withdrawals_to_counter_party_60d",
    "rolling_mean_of_withdrawals_to_counter_party_60d",
    "rolling_max_of_withdrawals_to_counter_party_60d",
    "rolling_min_of_withdrawals_to_counter_party_60d",
    "rolling_count_of_payments_to_counter_party_60d",
    "rolling_sum_of_withdrawals_to_counter_party_abv_thresh_1000_60d",
    "rolling_sum_of_withdrawals_value_to_counter_party_abv_thresh_1000_60d",
    "rolling_sum_of_deposits_from_counter_party_60d",
    "rolling_mean_of_deposits_from_counter_party_60d",
    "rolling_max_of_deposits_from_counter_party_60d",
    "rolling_min_of_deposits_from_counter_party_60d",
    "rolling_count_of_payments_from_counter_party_60d",
    "rolling_sum_of_deposits_to_counter_party_abv_thresh_1000_60d",
    "rolling_sum_of_deposits_value_to_counter_party_abv_thresh_1000_60d",
    "new_payee_count_30mins",
    "new_payee_count_2h",
    "new_payee_count_48h",
    "average_deposit_value_1y",
    "max_deposit_value_1y",
    "average_withdrawal_value_60d",
    "average_withdrawal_value_1y",
    "max_withdrawal_value_1y",
    "number_of_tester_payments_24h",
    "number_of_withdrawals_over_threshold_60d",
    "number_of_accounts_with_the_same_payee",
    "number_of_payments_outside_9am_to_10pm_60d",
    "number_of_high_outgoing_fastpayments_on_account_48h",
    "number_of_high_outgoing_fastpayments_on_account_60d",
    "payment_initiated_hour_max_48h",
    "payment_initiated_hour_min_48h",
    "percentage_cardpayments_of_all_withdrawals_1y",
    "percentage_fastpayments_of_all_withdrawals_1y",
    "percentage_directdebits_of_all_withdrawals_1y",
    "percentage_cardwithdrawals_of_all_withdrawals_1y",
    "percentage_outpayments_of_all_withdrawals_1y",
    "percentage_fastpayments_of_all_deposits_1y",
    "percentage_cashdeposits_of_all_deposits_1y",
    "percentage_inpayments_of_all_deposits_1y",
    "number_of_high_card_payments_on_account_1y",
    "number_of_high_card_withdrawals_on_account_1y",
    "number_of_high_outgoing_fastpayments_on_account_1y",
    "number_of_high_outpayments_on_account_1y",
    "number_of_high_directdebits_on_account_1y",
    "number_of_high_incoming_fastpayments_on_account_1y",
    "number_of_maximum_cash_deposits_on_account_1y",
    "number_of_high_inpayments_on_account_1y",
)


def fill_zero_columns() -> list[str]:
    return list(FILL_ZERO)


# Channel shares in tie-break order, and the high-value counts.
WITHDRAWAL_CHANNELS = {
    "percentage_cardpayments_of_all_withdrawals_1y": "card_payment",
    "percentage_fastpayments_of_all_withdrawals_1y": "fast_payment",
    "percentage_directdebits_of_all_withdrawals_1y": "direct_debit",
    "percentage_cardwithdrawals_of_all_withdrawals_1y": "card_withdrawal",
    "percentage_outpayments_of_all_withdrawals_1y": "out_payment",
}
DEPOSIT_CHANNELS = {
    "percentage_fastpayments_of_all_deposits_1y": "fast_payment",
    "percentage_cashdeposits_of_all_deposits_1y": "cash_deposit",
    "percentage_inpayments_of_all_deposits_1y": "in_payment",
}
HIGH_VALUE_COUNTS = (
    "number_of_high_card_payments_on_account_1y", "number_of_high_card_withdrawals_on_account_1y",
    "number_of_high_outgoing_fastpayments_on_account_1y", "number_of_high_outpayments_on_account_1y",
    "number_of_high_directdebits_on_account_1y", "number_of_high_incoming_fastpayments_on_account_1y",
    "number_of_maximum_cash_deposits_on_account_1y", "number_of_high_inpayments_on_account_1y",
)


def strict_greatest(cols: list[Column]) -> Column:
    """Maximum that is null when any input is null (``greatest`` alone skips nulls)."""
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.greatest(*cols))


def argmax_label(labels: dict[str, str]) -> Column:
    """Label of the largest column, the first one on ties, null when all are null."""
    top = F.greatest(*labels)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for col, label in labels.items():
        out = out.when(F.col(col) == top, F.lit(label))
    return out


def _on_account(flow: str, h: int) -> Column:
    return F.col(f"rolling_sum_of_{flow}_on_account_{h}h")


def net_balance_indicator() -> Column:
    """max over windows of (|out| + req - |in|) / (|out| + req + |in|); null if any is undefined."""
    r = F.col(REQ)
    return strict_greatest([
        F.try_divide(F.abs(_on_account("withdrawals", h)) + r - F.abs(_on_account("deposits", h)),
                     F.abs(_on_account("withdrawals", h)) + r + F.abs(_on_account("deposits", h))) for h in HOURS])


def cashflow_value_indicator() -> Column:
    return strict_greatest([_on_account("deposits", h) + F.abs(_on_account("withdrawals", h)) + F.col(REQ) for h in HOURS])


def deposit_withdrawal_ratio() -> Column:
    """max over windows of (out + 1 - in) / (out + 1 + in) on payment counts."""
    def one(h: int) -> Column:
        out, inc = _on_account("outgoing_payments", h), _on_account("incoming_payments", h)
        return F.try_divide(out + 1 - inc, out + 1 + inc)

    return strict_greatest([one(h) for h in HOURS])


def cashflow_volume_indicator() -> Column:
    return strict_greatest([_on_account("outgoing_payments", h) + _on_account("incoming_payments", h) + 1 for h in HOURS])


def requested_ratio(feature: Column) -> Column:
    return F.try_divide(F.col(REQ), F.col(REQ) + feature)


def requested_ratios() -> dict[str, Column]:
    """Eight shares of the request in (request + reference amount)."""
    out = {}
    for kind, size in (("withdrawal", F.abs), ("deposit", lambda c: c)):
        for word, col, span in (("mean", "average", "60d"), ("max", "max", "60d"), ("average", "average", "1y"), ("max", "max", "1y")):
            out[f"payment_requested_{word}_{kind}_ratio_{span}"] = requested_ratio(size(F.col(f"{col}_{kind}_value_{span}")))
    return out


def days_since_last_withdrawal(request: str, last: str) -> Column:
    """Whole days (half-even), held to 0..60; null stays null. Arguments are epoch seconds."""
    days = F.bround((F.col(request).cast("double") - F.col(last).cast("double")) / DAY, 0)
    return F.when(days.isNotNull(), F.least(F.greatest(days, F.lit(0.0)), F.lit(60.0)))


def previous_payment_within(request: str, last: str, minutes: int = 15, bounded: bool = False) -> Column:
    """1 when the last request was less than ``minutes`` ago; ``bounded`` also asks it not to lie ahead."""
    gap = (F.col(request).cast("double") - F.col(last).cast("double")) / 60
    hit = (gap < minutes) & (gap >= 0) if bounded else gap < minutes
    return F.coalesce(hit.cast("int"), F.lit(0))


def seconds_since_confirmation(request: str, confirmed: str) -> Column:
    """Seconds since the payee was confirmed; a year when unknown or zero."""
    c = F.col(confirmed)
    return F.when(c.isNull() | (c == 0), F.lit(YEAR_SECONDS)).otherwise(F.col(request) - c).cast("long")


def to_new_payee(amount: Column, seconds: Column, hours: int) -> Column:
    """The amount when the payee is younger than ``hours``, else 0."""
    return amount * (seconds < hours * HOUR).cast("int")


def derived_features(seconds: str = "time_passed_since_confirmation_of_payee") -> dict[str, Column]:
    """Ratios and composites that need the filled inputs and the seconds since confirmation."""
    c, r, s = F.col, F.col(REQ), F.col(seconds)
    cp = lambda stat, flow, way, w: c(f"rolling_{stat}_of_{flow}_{way}_counter_party_{w}")
    over = lambda w: c(f"rolling_sum_of_withdrawals_value_to_counter_party_abv_thresh_1000_{w}")
    in2, in60 = _on_account("incoming_payments", 2), c("incoming_payments_sum_account_60d")
    maxw, maxd = c("max_withdrawal_value_60d"), c("max_deposit_value_60d")
    total60 = c("average_withdrawal_value_60d") * c("outgoing_payments_sum_account_60d")
    share = lambda w, total: F.try_divide(cp("sum", "withdrawals", "to", w), total + 1)
    return {
        "payments_initiated_hour_48h_range": c("payment_initiated_hour_max_48h") - c("payment_initiated_hour_min_48h"),
        "ratio_pmts_outside_business_60d": F.try_divide(c("number_of_payments_outside_9am_to_10pm_60d"), c("outgoing_payments_sum_account_60d") + 1),
        "days_since_confirmation_of_payee": F.least(s / DAY, F.lit(365.0)),
        "hours_since_confirmation_of_payee": F.least(s / HOUR, F.lit(48.0)),
        "incoming_payment_requested_avg_pmt_value_with_payee_ratio_60d": F.try_divide(r, cp("mean", "deposits", "from", "60d") + 1),
        "outgoing_payment_requested_avg_pmt_value_with_payee_ratio_60d": F.try_divide(r, cp("mean", "withdrawals", "to", "60d") + 1),
        "mean_of_payments_to_new_payees_60d": to_new_payee(cp("mean", "withdrawals", "to", "60d"), s, 1),
        "sum_of_payments_to_new_payees_48h": to_new_payee(cp("sum", "withdrawals", "to", "48h"), s, 48),
        "rolling_sum_of_pmts_over_threshold_to_new_payee_48h": to_new_payee(over("48h"), s, 48),
        "rolling_sum_of_pmts_over_threshold_to_new_payee_60d": to_new_payee(over("60d"), s, 48),  # 48 h, as defined
        "ratio_of_pmts_value_to_payee_of_overall_pmts_2h": share("2h", _on_account("withdrawals", 2)),
        "ratio_of_pmts_value_to_payee_of_overall_pmts_48h": share("48h", _on_account("withdrawals", 48)),
        "ratio_of_pmts_value_to_payee_of_overall_pmts_60d": share("60d", total60),
        "incoming_payment_density_over_the_past_2h_vs_60days": (in60 - in2) * in2,
        "incoming_payment_density_over_the_past_2h_vs_60days_ratio": F.try_divide(in60 - in2, in60 + 1),
        "ratio_of_rolling_sum_of_wtd_2h_to_max_wtd_60d": F.try_divide(maxw - _on_account("withdrawals", 2), maxw + 1),
        "ratio_of_rolling_sum_of_deposits_2h_to_max_deposit_60d": F.try_divide(maxd - _on_account("deposits", 2), maxd + 1),
        # a value, not a count, under the name its readers use
        "count_above_thr_deposite_from_counter_party_1000_60d": c("rolling_sum_of_deposits_value_to_counter_party_abv_thresh_1000_60d"),
        "avg_no_payment_to_from_counter_party": (c("rolling_count_of_payments_from_counter_party_48h") + c("rolling_count_of_payments_to_counter_party_48h")) / 2,
        "payment_transfer_rate_on_cop": F.ln(F.try_divide(r, s + 1)),
        "requested_payment_to_avg_deposit_60d_ratio": F.try_divide(r, c("average_deposit_value_60d") + 1),
        "is_requested_payment_gt_60day_max_wtd": F.coalesce((r > maxw).cast("int"), F.lit(0)),
    }


def tidy_text(col: str, replacements: dict[str, str]) -> Column:
    """Lower case with spelling variants replaced; null stays null."""
    low = F.lower(F.col(col).cast("string"))
    out = low
    for old, new in replacements.items():
        out = F.when(low == old, F.lit(new)).otherwise(out)
    return out


def member_columns() -> dict[str, Column]:
    """Area code, country, id type and company type in their canonical spelling."""
    country = F.col("member_id_country_issue")
    return {
        "member_area_code": area_code("member_postcode"),
        "member_id_country_issue": F.when(country == "GB", "GBR").otherwise(country),
        "member_id_type": tidy_text("member_id_type", {"driving_license": "driving_licence"}),
        "registered_company_type": tidy_text("registered_company_type", {"private-limited-guarant-nsc": "private_limited_guarant_nsc"}),
    }


def preprocess(df: DataFrame) -> DataFrame:
    """The whole feature chain on a table with business column names.

    Columns of a family that are absent are created as null, so partial inputs work; all
    steps are projections, so the plan is one code-generated stage and streams can use it.
    """
    needed = [*FILL_ONE, *fill_zero_columns(), "rule_feature_request_timestamp", "timestamp_ntm_recipient_confirmed",
              "last_payment_requested_received_at_60d", "number_of_fastpayment_beneficiaries_1y",
              "number_of_fastpayment_benefactors_1y"]
    texts = ["member_postcode", "member_id_country_issue", "member_id_type", "registered_company_type",
             "registered_company_industry_classification"]
    have = set(df.columns)
    x = df.withColumns({n: F.lit(None).cast("double") for n in needed if n not in have}
                       | {n: F.lit(None).cast("string") for n in texts if n not in have})
    x = x.withColumns(member_columns())
    x = x.withColumns({n: F.coalesce(F.col(n), F.lit(1)) for n in FILL_ONE}
                      | {n: F.coalesce(F.col(n), F.lit(0)) for n in fill_zero_columns()})
    req, last = "rule_feature_request_timestamp", "last_payment_requested_received_at_60d"
    x = x.withColumns({
        "net_balance_indicator": net_balance_indicator(), "cashflow_value_indicator": cashflow_value_indicator(),
        "deposit_withdrawal_ratio": deposit_withdrawal_ratio(), "cashflow_volume_indicator": cashflow_volume_indicator(),
        "time_passed_since_confirmation_of_payee": seconds_since_confirmation(req, "timestamp_ntm_recipient_confirmed"),
        **requested_ratios(),
        "payment_channel_most_used_for_withdrawals": argmax_label(WITHDRAWAL_CHANNELS),
        "payment_channel_most_used_for_deposits": argmax_label(DEPOSIT_CHANNELS),
        "number_of_high_value_transactions_1y": sum((F.col(n) for n in HIGH_VALUE_COUNTS), F.lit(0)),
        "number_of_days_since_last_withdrawal_60d": days_since_last_withdrawal(req, last),
        "is_previous_payment_in_last_15mins": previous_payment_within(req, last),
        "fastpmt_beneficiaries_benefactors_ratio_1y": F.try_divide(
            F.col("number_of_fastpayment_beneficiaries_1y"),
            F.col("number_of_fastpayment_beneficiaries_1y") + F.col("number_of_fastpayment_benefactors_1y")),
    })
    return x.withColumns(derived_features())


# Constants that replace missing derived features.
IMPUTE_CONSTANTS = {
    "is_registered_company": 0, "net_balance_indicator": -1, "number_of_days_since_last_withdrawal_60d": 60,
    **{n: "missing" for n in ("member_area_code", "member_id_country_issue", "member_id_type", "registered_company_type",
                              "registered_company_industry_classification")},
    **{n: "fast_payment" for n in ("payment_channel_most_used_for_withdrawals", "payment_channel_most_used_for_deposits")},
    **{n: 0 for n in (
        "ratio_of_rolling_sum_of_wtd_2h_to_max_wtd_60d", "ratio_of_pmts_value_to_payee_of_overall_pmts_60d",
        "ratio_of_pmts_value_to_payee_of_overall_pmts_48h", "ratio_of_pmts_value_to_payee_of_overall_pmts_2h",
        "cashflow_value_indicator", "cashflow_volume_indicator", "deposit_withdrawal_ratio",
        "number_of_high_value_transactions_1y", "number_of_withdrawals_over_threshold_60d",
        "is_previous_payment_in_last_15mins", "fastpmt_beneficiaries_benefactors_ratio_1y",
        "number_of_tester_payments_1y", "number_of_latehours_cash_transactions_1y", "number_of_card_acceptors_1y",
        "number_of_direct_debit_beneficiaries_1y", "number_of_hmrc_transactions_1y", "number_of_xero_transactions_1y",
        "number_of_atms_used_1y", "number_of_cards_used_1y", "number_of_tester_payments_24h",
        "percentage_of_round_transactions_1y", "outgoing_payments_sum_account_60d", "incoming_payments_sum_account_60d",
        "incoming_payment_density_over_the_past_2h_vs_60days_ratio", "ratio_pmts_outside_business_60d",
        "incoming_payment_requested_avg_pmt_value_with_payee_ratio_60d",
        "outgoing_payment_requested_avg_pmt_value_with_payee_ratio_60d", "mean_of_payments_to_new_payees_60d",
        "sum_of_payments_to_new_payees_48h", "rolling_sum_of_pmts_over_threshold_to_new_payee_48h",
        "rolling_sum_of_pmts_over_threshold_to_new_payee_60d", "incoming_payment_density_over_the_past_2h_vs_60days",
        "ratio_of_rolling_sum_of_deposits_2h_to_max_deposit_60d", "count_above_thr_deposite_from_counter_party_1000_60d",
        "payment_transfer_rate_on_cop", "requested_payment_to_avg_deposit_60d_ratio",
        "is_requested_payment_gt_60day_max_wtd")},
}
IMPUTE_MEDIANS = ("member_age_at_onboarding", "deposit_withdrawal_frequency_ratio_1y")
