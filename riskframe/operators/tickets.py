"""Fraud tickets: unpivoted references, parent tickets, first ticket per transaction."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import first_per_key

# Characters stripped from references, and fraud-type roll-ups.
REFERENCE_NOISE = r'[\s,"\]]'
VICTIM_TYPES = {
    "Invoice Interception Scam": "Invoice interception scam",
    "Impersonation Scam": "Impersonation scam",
    "Safe Account Scam": "Safe account scam",
    "Investment Scam": "Investment scam",
    "Purchase Scam": "Purchase scam",
    "Other": "Unknown scam",
}
PERPETRATOR_TYPES = {
    "Invoice scams": "Invoice and Mandate scam",
    "Mail boxes and multiple post redirections": "Invoice and Mandate scam",
    "Safe account scam": "Safe account scam",
    "Mule": "Safe account scam",
    "HMRC scam": "Impersonation scam",
    "Telephone banking scam": "Impersonation scam",
    "Impersonation scam": "Impersonation scam",
    "Investment scam": "Investment scam",
    "Cryptocurrency investment fraud": "Investment scam",
    "Advance fee fraud": "Advance fee scam",
    "419 emails and letters": "Advance fee scam",
    "Romance scam": "Romance scam",
    "Purchase scam": "Purchase scam",
    "Other": "Unknown scam",
    "Not provided": "Unknown scam",
}


def clean_reference(ref: Column | str) -> Column:
    c = F.col(ref) if isinstance(ref, str) else ref
    return F.regexp_replace(F.trim(c), REFERENCE_NOISE, "")


def roll_up(kind: Column | str, mapping: dict[str, str]) -> Column:
    """Mapped category; unknown values pass through."""
    c = F.col(kind) if isinstance(kind, str) else kind
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, c), c)


def reference_rows(tickets: DataFrame, key: str, columns: list[str], out: str = "txn_ref") -> DataFrame:
    """Reference columns to distinct (ticket, reference) rows in one scan, nulls dropped."""
    return (tickets.select(key, F.explode(F.array(*columns)).alias("__ref")).where("__ref is not null")
            .select(key, clean_reference("__ref").alias(out)).distinct())


def with_parent(tickets: DataFrame, coalesced: list[str], key: str = "ticket_key", parent: str = "parent_key") -> DataFrame:
    """Attach the parent's values where the ticket has none, and the key of the case (parent or self)."""
    up = tickets.select(F.col(key).alias("__up"), *[F.col(c).alias(f"__up_{c}") for c in coalesced])
    joined = tickets.join(up, F.col(parent) == F.col("__up"), "left")
    others = [c for c in tickets.columns if c not in coalesced]
    return joined.select(*others, *[F.coalesce(c, f"__up_{c}").alias(c) for c in coalesced],
                         F.coalesce(parent, key).alias("case_key"))


def first_ticket_per_transaction(rows: DataFrame, txn: str = "txn_ref", created: str = "ticket_created_at",
                                 tie: str = "ticket_key") -> DataFrame:
    return first_per_key(rows, [txn], [F.col(created).asc(), F.col(tie).asc()])


def victim_transactions(tickets: DataFrame, transactions: DataFrame, ref_columns: list[str], project: str,
                        start, stop, mapping: dict[str, str] = VICTIM_TYPES, payments: DataFrame | None = None) -> DataFrame:
    """Transactions named in victim tickets of a project, reported in the period.

    ``tickets``: ticket_key, parent_key, project_key, company_id, date_of_report, fraud_type,
    ticket_created_at and the reference columns. ``transactions``: txn_ref, amount, transaction_at.
    ``payments`` (txn_ref, sort_code, bank_name) adds the two columns where a payment is known.
    Tickets that name no known transaction have none to report and are left out on purpose.
    """
    refs = reference_rows(tickets, "ticket_key", ref_columns)
    cases = with_parent(tickets.drop(*ref_columns), ["company_id", "date_of_report", "fraud_type"]).where(
        F.col("project_key") == project)
    named = cases.join(refs, "ticket_key").join(transactions, "txn_ref")
    first = first_ticket_per_transaction(named)
    mapped = first.withColumn("mapped_fraud_type", roll_up("fraud_type", mapping))
    extra = []
    if payments is not None:
        mapped, extra = mapped.join(payments.select("txn_ref", "sort_code", "bank_name").dropDuplicates(["txn_ref"]), "txn_ref", "left"), ["sort_code", "bank_name"]
    return mapped.where(F.col("date_of_report").between(F.lit(start), F.lit(stop))
                        & F.col("mapped_fraud_type").isin(sorted(set(mapping.values())))).select(
        "company_id", F.col("case_key").alias("ticket_key"), "date_of_report", "fraud_type", "txn_ref",
        F.abs("amount").alias("amount"), "transaction_at", "mapped_fraud_type", *extra)


def reported_tickets(tickets: DataFrame, changes: DataFrame, project: str, change_field: str, start, stop,
                     skip_status: tuple[str, ...] = ("Duplicate", "Duplicates"),
                     kinds: tuple[str, ...] = tuple(PERPETRATOR_TYPES)) -> DataFrame:
    """Reported date per ticket: the first change of ``change_field``, else its creation.

    The subtask test is the plain ``<> 1``, which also drops null flags.
    """
    kept = tickets.where((F.col("project_key") == project) & F.col("number_of_reports").isNotNull()
                         & (F.col("is_subtask") != 1) & F.col("fraud_type").isin(*kinds)
                         & ~F.col("ticket_status").isin(*skip_status))
    moved = changes.where(F.col("change_field") == change_field).select("ticket_id", "change_at")
    at = F.coalesce("change_at", "ticket_created_at")
    day = F.to_date(at)
    return (kept.join(moved, "ticket_id", "left").where(day.between(F.lit(start), F.lit(stop)))
            .groupBy("ticket_key", "company_id", "ticket_id").agg(F.min(at).alias("reported_date"))
            .where(F.col("reported_date").between(F.lit(start), F.lit(stop))))


def perpetrator_transactions(tickets: DataFrame, changes: DataFrame, transactions: DataFrame, companies: DataFrame,
                             memberships: DataFrame, ref_columns: list[str], project: str, change_field: str,
                             start, stop, year: int, mapping: dict[str, str] = PERPETRATOR_TYPES,
                             company_columns: tuple[str, ...] = (), member_columns: tuple[str, ...] = ()) -> DataFrame:
    """Transactions named in perpetrator tickets, enriched with company and membership.

    The company is the ticket's, or the transaction's where the ticket has none; company and
    membership facts are those of the transaction's company. ``transactions`` also carry
    company_id, ``companies`` member_id and ``company_columns`` (such as is_registered,
    first_transaction_at, industry, is_cofo, incorporation_at), ``memberships``
    manual_approval_triggers, risk_rating and ``member_columns`` (such as approved_at,
    marketing channel, risk_band).
    """
    reported = reported_tickets(tickets, changes, project, change_field, start, stop)
    refs = reference_rows(tickets, "ticket_key", ref_columns)
    own = tickets.where(F.col("project_key") == project).select(
        "ticket_key", "parent_key", "ticket_created_at", F.col("company_id").alias("ticket_company"), F.col("fraud_type").alias("own_type"))
    up = tickets.select(F.col("ticket_key").alias("__up"), F.col("fraud_type").alias("parent_type"))
    in_year = transactions.where(F.year("transaction_at") == year)
    named = (own.join(refs, "ticket_key").join(in_year, "txn_ref")
             .join(up, F.col("parent_key") == F.col("__up"), "left"))
    first = first_ticket_per_transaction(named).select(
        "company_id", "ticket_company", "txn_ref", "transaction_at", "amount",
        F.coalesce("parent_key", "ticket_key").alias("ticket_key"),
        F.when(F.col("parent_key").isNull(), F.col("own_type")).otherwise(F.col("parent_type")).alias("fraud_type"))
    enriched = first.join(companies, "company_id", "left").join(memberships, "member_id", "left")
    manual = F.when(F.col("manual_approval_triggers") != "", "Yes").otherwise("No")
    joined = enriched.join(reported.select("ticket_key"), "ticket_key")
    return joined.select(F.coalesce("ticket_company", "company_id").alias("company_id"), "ticket_key", "txn_ref", "transaction_at", "amount",
                         "fraud_type", "risk_rating", *company_columns, *member_columns, manual.alias("manual_kyc"), roll_up("fraud_type", mapping).alias("mapped_fraud_type")).where(
        F.col("mapped_fraud_type").isin(sorted(set(mapping.values()))))
