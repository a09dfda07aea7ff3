"""Logical inputs (members, transactions, events...) derived from the given tables.

Each view exists twice, as a DataFrame and as the SQL common table expression the reference
SQL of the registered queries starts from.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables

NUDGE = 1e-9  # moves exact halves off the tie, so summation order cannot flip the last digit


def rnd(c, digits: int):
    """Rounded column, equal to ``R`` in SQL (adding 0.0 turns -0.0 into 0.0)."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(NUDGE), digits) + F.lit(0.0)


def R(expr: str, digits: int) -> str:
    return f"(round({expr} + 1e-9, {digits}) + 0.0)"


def period(t: Tables) -> tuple[date, date]:
    """First and last order date: one row of two dates."""
    row = t.orders.agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("z")).first()
    return row["a"], row["z"]




def members(t: Tables) -> DataFrame:
    span = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("approved_at"),
                                             F.max("o_orderdate").alias("last_at"))
    return t.customer.join(span, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").cast("string").alias("company_id"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nationkey"), F.lit(1).alias("is_approved"),
        F.col("approved_at").cast("date").alias("approved_at"),
        (F.col("c_acctbal") < 0).cast("int").alias("is_rejected"),
        F.when(F.col("c_acctbal") < 0, F.col("last_at").cast("date")).alias("rejected_at"))


MEMBERS = """members AS (
  SELECT CAST(c_custkey AS VARCHAR) AS company_id, c_mktsegment AS segment, c_nationkey AS nationkey,
    CAST(a AS DATE) AS approved_at, CAST(c_acctbal < 0 AS INT) AS is_rejected,
    CASE WHEN c_acctbal < 0 THEN CAST(z AS DATE) END AS rejected_at
  FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1)
    ON c_custkey = o_custkey)"""


def transactions(t: Tables) -> DataFrame:
    """Cleared transactions of P1: orders, a fifth of them of type Fee."""
    return t.orders.select(
        F.col("o_custkey").cast("string").alias("company_id"), F.col("o_orderkey").alias("transaction_id"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Fee").otherwise("Payment").alias("transactiontype"),
        F.col("o_orderdate").cast("date").alias("transactiondate"),
        (F.col("o_orderstatus") != "P").cast("int").alias("fullycleared"))


TRANSACTIONS = """transactions AS (
  SELECT CAST(o_custkey AS VARCHAR) AS company_id, o_orderkey AS transaction_id, o_totalprice AS amount,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'Fee' ELSE 'Payment' END AS transactiontype,
    CAST(o_orderdate AS DATE) AS transactiondate, CAST(o_orderstatus <> 'P' AS INT) AS fullycleared
  FROM orders)"""


def reports(t: Tables) -> DataFrame:
    """Reports against a company: its orders of status F."""
    return t.orders.where("o_orderstatus = 'F'").select(
        F.col("o_custkey").cast("string").alias("company_id"), F.col("o_orderkey").alias("report_id"),
        F.col("o_orderdate").cast("date").alias("reported_at"))


REPORTS = """reports AS (
  SELECT CAST(o_custkey AS VARCHAR) AS company_id, o_orderkey AS report_id, CAST(o_orderdate AS DATE) AS reported_at
  FROM orders WHERE o_orderstatus = 'F')"""

CALENDAR = """calendar AS (
  SELECT CAST(unnest(generate_series(date_trunc('month', (SELECT min(o_orderdate) FROM orders)),
    date_trunc('month', (SELECT max(o_orderdate) FROM orders)), INTERVAL 1 MONTH)) AS DATE) AS feature_date)"""

SPINE = """spine AS (
  SELECT company_id, segment, feature_date AS timestamp FROM calendar JOIN members
  ON approved_at < feature_date AND (is_rejected = 0 OR (is_rejected = 1 AND rejected_at > feature_date)))"""


def payments(t: Tables) -> DataFrame:
    """Payment events: direction and channel from the type, counterparty from the payload."""
    deposit = F.col("event_type").isin("signup", "click")
    return t.events.select(
        "event_id", "ts", F.col("user_id").alias("account_id"), "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("counterparty"), F.col("value").alias("amount"),
        F.when(deposit, F.col("value")).alias("deposit"), F.when(~deposit, F.col("value")).alias("withdrawal"))


PAYMENTS = """payments AS (
  SELECT event_id, ts, user_id AS account_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS counterparty,
    value AS amount, CASE WHEN event_type IN ('signup', 'click') THEN value END AS deposit,
    CASE WHEN event_type NOT IN ('signup', 'click') THEN value END AS withdrawal
  FROM events)"""


def supervised(t: Tables) -> DataFrame:
    """Labelled rows: line items with part attributes; y = discounted amount above 3000."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_key"),
        F.col("l_orderkey").alias("company_id"), "l_linenumber", "l_suppkey", "l_shipdate", "l_linestatus",
        "l_returnflag", "p_brand", "p_type", "p_size", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        (F.col("l_extendedprice") * F.col("l_discount") > 3000).cast("int").alias("y"),
        (1 / (1 + F.exp(-(F.col("l_quantity") / 10 + F.col("l_discount") * 20 - 4)))).alias("score"))


SUPERVISED = """supervised AS (
  SELECT l_orderkey * 10 + l_linenumber AS row_key, l_orderkey AS company_id, l_linenumber, l_suppkey, l_shipdate,
    l_linestatus, l_returnflag, p_brand, p_type, p_size, l_quantity, l_discount, l_tax, l_extendedprice,
    CAST(l_extendedprice * l_discount > 3000 AS INT) AS y,
    1 / (1 + exp(-(l_quantity / 10 + l_discount * 20 - 4))) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
