"""Cleared-transaction facts from JSON event payloads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import json_at, json_document

# Transfer codes, status, and the day the event type changed.
TRANSFER_CODES = ("DOMESTIC_TRANSFER", "INTERNAL_BOOK_TRANSFER")
CLEARED = "CLEARED"
SWITCH_DATE = datetime(2021, 7, 1)


def cleared_transactions(events: DataFrame, start, stop, received: str, created: str, side: str = "both",
                         issuer: str | None = None, switch=SWITCH_DATE, codes: tuple[str, ...] = TRANSFER_CODES) -> DataFrame:
    """Cleared transfers between two instants (both open), of one side or both.

    Before ``switch`` the ``received`` events count, from it on the ``created`` events; their
    amounts sit at different JSON paths, in minor units. ``side`` is both, DEBIT or CREDIT.
    The type and time tests come first, so they reach the scan; the payload is parsed
    only for the remaining rows.
    """
    ts, kind = F.col("timestamp"), F.col("event_type")
    timed = events.where((ts > F.lit(start)) & (ts < F.lit(stop)) & (
        ((kind == received) & (ts < F.lit(switch))) | ((kind == created) & (ts >= F.lit(switch)))))
    # exploding a one-element array pins the parse: filters below would otherwise repeat it each
    v = timed.select("*", F.explode(F.array(json_document("payload"))).alias("__v")).where("__v is not null")

    def at(path: str, kind_: str = "string"):
        return json_at("__v", path, kind_)

    code = "proprietaryBankTransactionCode"
    keep = at(f"{code}.code").isin(*codes) & (at("status") == CLEARED)
    if side != "both":
        keep = keep & (at("creditDebitIndicator") == side)
    if issuer is not None:
        keep = keep & (at(f"{code}.issuer") == issuer)
    minor = F.when(kind == received, at("amount.value", "double")).otherwise(at("amount.amount", "double"))
    return v.where(keep).select(
        "timestamp", at("accountId").alias("account_id"), at("transactionId").alias("transaction_id"),
        F.coalesce(F.right(F.trim(at("creditorAccount.identification")), F.lit(8)), F.lit("-")).alias("destination_account_id"),
        F.coalesce(F.left(F.trim(at("creditorAccount.identification")), F.lit(6)), F.lit("-")).alias("destination_sort_code"),
        at("debtorAccount.identification").alias("source_account_identification"),
        at(f"{code}.issuer").alias("issuer"), (minor / 100.0).alias("requested_payment_value"))


def with_company(transactions: DataFrame, accounts: DataFrame, companies: DataFrame, memberships: DataFrame) -> DataFrame:
    """Inner key chain account -> company -> membership, keys compared as text."""
    text = lambda df, c: df.withColumn(c, F.col(c).cast("string"))
    keyed = text(text(accounts, "account_id"), "company_id")
    return (transactions.join(keyed, "account_id").join(text(companies, "company_id"), "company_id")
            .join(memberships, "membership_id"))


def prediction_history(predictions: DataFrame, start, stop, date_col: str = "evaluation_date") -> DataFrame:
    return predictions.where(F.col(date_col).between(F.lit(start), F.lit(stop)))
