"""Rule flags of a payment request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exempted account and sort-code pairs, and the life of a credit event.
EXEMPTED = (
    "12001039083210", "12001020083210", "11963155083200", "41320424406425", "00200476300000", "00331708300000",
    "12000962083200",
)
CREDIT_EVENT_SECONDS = 30
T = "rule_feature_request_timestamp"
# What a missing rule input means.
DEFAULTS = {
    "rule_feature_kyc_risk_band": "HIGH", "rule_feature_is_clearlisted": False,
    "rule_feature_clearlisting_last_updated_at": 0, "rule_feature_event_ignore_expiration": False,
    "rule_feature_permenant_clearlisting_last_whitelisted_at": 0, "rule_feature_is_source_dest_clearlisted": False,
}


def recipient_exempted(codes: tuple[str, ...] = EXEMPTED) -> Column:
    """Account number followed by sort code is on the exempted list."""
    pair = F.concat(F.coalesce(F.col("destination_account_number").cast("string"), F.lit("")),
                    F.coalesce(F.col("destination_account_sort_code").cast("string"), F.lit("")))
    return pair.isin(*codes).cast("int")


def permanently_clearlisted() -> Column:
    """Request after a positive permanent allow-listing time."""
    at = F.col("rule_feature_permenant_clearlisting_last_whitelisted_at")
    return F.coalesce(((F.col(T) > at) & (at > 0)).cast("int"), F.lit(0))


def pair_clearlisted() -> Column:
    """Source-destination pair listed, before its expiry and within its amount."""
    hit = (F.col("rule_feature_is_source_dest_clearlisted").cast("boolean") & (F.col(T) < F.col("rule_feature_source_dest_expiry_ts"))
           & (F.col("requested_payment_value") <= F.col("rule_feature_source_dest_amount")))
    return F.coalesce(hit.cast("int"), F.lit(0))


def matching_credit_event(seconds: int = CREDIT_EVENT_SECONDS, bounded: bool = False) -> Column:
    """A credit event of at least the request's amount within ``seconds``.

    Without ``bounded`` an event after the request also matches, as in the rule's definition.
    """
    amount, at = F.col("rule_feature_credit_line_amount"), F.col("rule_feature_credit_line_last_updated_at")
    gap = F.col(T).cast("double") - at.cast("double")
    hit = (amount > 0) & (at > 0) & (F.col("requested_payment_value") <= amount) & (gap < seconds)
    if bounded:
        hit = hit & (gap >= 0)
    return F.coalesce(hit.cast("int"), F.lit(0))


def with_rule_defaults(df: DataFrame) -> DataFrame:
    """Fill missing rule inputs; times that do not parse become 0 and the band upper case."""
    out = {}
    for name, value in DEFAULTS.items():
        c = F.col(name)
        if isinstance(value, bool):
            out[name] = F.coalesce(c.try_cast("boolean"), F.lit(value))
        elif isinstance(value, int):
            out[name] = F.coalesce(c.try_cast("double").cast("long"), F.lit(value))
        else:
            out[name] = F.upper(F.coalesce(c.cast("string"), F.lit(value)))
    return df.withColumns(out)


def apply_rules(df: DataFrame) -> DataFrame:
    """Add the four rule flags. The two allow-list flags replace their inputs."""
    return with_rule_defaults(df).withColumns({
        "rule_feature_is_recipient_account_exempted": recipient_exempted(),
        "rule_feature_is_matching_credit_event": matching_credit_event(),
        "rule_feature_is_clearlisted": permanently_clearlisted(),
        "rule_feature_is_source_dest_clearlisted": pair_clearlisted(),
    })
