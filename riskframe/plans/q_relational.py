"""Registered queries: sources, projections, filters, joins, aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, labels, prefix, profile, sequence, splits, tickets, validate
from ..sources import names, readers, sinks
from ..streaming.run import scratch
from . import standins as v
from .registry import Tables, query
from .standins import R, rnd

MIX = "((({id} % 1000003) * 7919 + {seed}) % 1000003)"


# ---- sources and sinks -------------------------------------------------------------------

@query("src1_src2_query_with_arguments", f"""SELECT o_orderpriority, count(*) AS n, {R('sum(o_totalprice)', 2)} AS total FROM orders
WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY 1""")
def src1(t: Tables):
    out = readers.read_query(t.spark, """SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM {0}
        WHERE o_orderdate >= :start AND o_orderdate < :stop GROUP BY o_orderpriority""".format("orders_in"),
        views={"orders_in": t.orders}, args={"start": "1997-01-01", "stop": "1998-01-01"})
    return out.withColumn("total", rnd("total", 2))


def _scratch(t: Tables) -> str:
    return scratch(t.spark, "files")


@query("src3_snk1_parquet_round_trip", f"SELECT c_mktsegment, count(*) AS n, {R('sum(c_acctbal)', 2)} AS balance FROM customer GROUP BY 1")
def src3(t: Tables):
    path = _scratch(t) + "/customer"
    sinks.write_dataset(t.customer, path)
    back = readers.read_parquet(t.spark, path, t.customer.schema)
    return back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("c_acctbal"), 2).alias("balance"))


@query("src4_src5_snk2_csv_round_trip", f"SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size_sum, {R('sum(p_retailprice)', 2)} AS price FROM part GROUP BY 1")
def src4(t: Tables):
    path = _scratch(t) + "/part_csv"
    sinks.write_csv(t.part, path)
    back = readers.read_csv(t.spark, path, t.part.schema)
    return back.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size_sum"), rnd(F.sum("p_retailprice"), 2).alias("price"))


@query("src6_area_list", "SELECT r_name AS area_code, count(*) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def src6(t: Tables):
    path = _scratch(t) + "/areas"
    t.region.select("r_name").write.csv(path)
    areas = readers.read_list(t.spark, path)
    joined = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))  # nation tables: fixed size
    return joined.join(F.broadcast(areas), F.col("r_name") == F.col("area_code")).groupBy("area_code").agg(F.count(F.lit(1)).alias("nations"))


@query("src7_jn6_source_for_spine", f"""WITH s AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS company_id, CAST(o_orderdate AS DATE) AS timestamp FROM orders
  WHERE o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'),
f AS (SELECT CAST(o_custkey AS VARCHAR) AS company_id, CAST(o_orderdate AS DATE) AS timestamp, sum(o_totalprice) AS day_total FROM orders
  WHERE o_orderpriority <> '1-URGENT' GROUP BY 1, 2)
SELECT s.company_id, s.timestamp, {R('f.day_total', 2)} AS day_total FROM s LEFT JOIN f USING (company_id, timestamp)""")
def src7(t: Tables):
    keyed = t.orders.select(F.col("o_custkey").cast("string").alias("company_id"), F.col("o_orderdate").cast("date").alias("timestamp"), "o_totalprice", "o_orderpriority")
    s = keyed.where("timestamp between date'1997-01-01' and date'1997-06-30'").select("company_id", "timestamp").distinct()
    f = keyed.where("o_orderpriority <> '1-URGENT'").groupBy("company_id", "timestamp").agg(F.sum("o_totalprice").alias("day_total"))
    return readers.source_for_spine(s, f, ["company_id"], "timestamp").withColumn("day_total", rnd("day_total", 2))


@query("snk3_partitioned_predictions", "SELECT year(o_orderdate) || '_' || month(o_orderdate) AS month_year, count(*) AS n FROM orders GROUP BY 1")
def snk3(t: Tables):
    path = _scratch(t) + "/predictions"
    keyed = t.orders.select("o_orderkey", F.concat_ws("_", F.year("o_orderdate"), F.month("o_orderdate")).alias("month_year"))
    # one writer per month would be a hot spot: rows keep their input partitions
    sinks.write_dataset(keyed, path, partition_by=["month_year"])
    return t.spark.read.parquet(path).groupBy(F.col("month_year").cast("string").alias("month_year")).agg(F.count(F.lit(1)).alias("n"))


@query("snk4_snk5_build_once", "SELECT 'risk_01_1995_08_2001' AS dataset, count(*) AS n, 1 AS builds FROM orders")
def snk4(t: Tables):
    name = sinks.dataset_name(1995, 1, 2001, 8, "risk")
    path, builds = f"{_scratch(t)}/{name}", []

    def build():
        builds.append(1)
        return t.orders.select("o_orderkey")

    for _ in range(2):
        df = sinks.build_once(t.spark, path, build)
    return df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n"), F.lit(len(builds)).alias("builds"))


# ---- projections -------------------------------------------------------------------------

@query("pr1_short_names", f"SELECT l_returnflag AS flag, l_linestatus AS status, {R('avg(l_quantity)', 4)} AS quantity FROM lineitem GROUP BY 1, 2")
def pr1(t: Tables):
    raw = t.lineitem.select(F.col("l_returnflag").alias("view_v1__FLAG"), F.col("l_linestatus").alias("view_v2__Status"), F.col("l_quantity").alias("other__quantity"))
    return names.normalise_names(raw).groupBy("flag", "status").agg(rnd(F.avg("quantity"), 4).alias("quantity"))


@query("pr2_pr3_business_names", f"""SELECT o_custkey AS company_id, {R('sum(o_totalprice)', 2)} AS rolling_sum_of_deposits_on_account_2h,
  max(o_totalprice) AS max_withdrawal_value_60d, count(*) AS number_of_tester_payments_1y FROM orders GROUP BY 1""")
def pr2(t: Tables):
    agg = t.orders.groupBy(F.col("o_custkey").alias("company_id")).agg(
        rnd(F.sum("o_totalprice"), 2).alias("rolling_sum_features_v4__deposits_sum_2h_continuous"),
        F.max("o_totalprice").alias("rolling_sum_features_v2__withdrawals_max_60days_continuous"),
        F.count(F.lit(1)).alias("company_transaction_features_v1__tester_pmt_cnt"))
    return names.to_business_names(names.canonical_names(agg))


@query("pr4_pr5_projection", f"SELECT l_linestatus, max(l_tax) AS max_tax, {R('sum(l_discount)', 4)} AS discounts FROM lineitem GROUP BY 1")
def pr4(t: Tables):
    fixed = t.lineitem.select("l_linestatus", "l_tax", "l_discount", "l_quantity").drop("l_quantity")
    return fixed.groupBy("l_linestatus").agg(F.max("l_tax").alias("max_tax"), rnd(F.sum("l_discount"), 4).alias("discounts"))


@query("pr6_combine_first", """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END, n_name) AS company_type
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def pr6(t: Tables):
    j = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")), "n_name").alias("company_type"))


@query("pr7_repair_types", """SELECT lang, count(*) AS n, count(TRY_CAST(a AS DOUBLE)) AS numbers, count(TRY_CAST(b AS DATE)) AS dates FROM (
  SELECT lang, CASE WHEN doc_id % 4 = 0 THEN source ELSE CAST(n_chars AS VARCHAR) END AS a,
    CASE WHEN doc_id % 5 = 0 THEN 'bad' ELSE '2023-01-' || lpad(CAST(1 + doc_id % 40 AS VARCHAR), 2, '0') END AS b FROM documents) GROUP BY 1""")
def pr7(t: Tables):
    raw = t.documents.select("lang", F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise(F.col("n_chars").cast("string")).alias("a"),
                             F.when(F.col("doc_id") % 5 == 0, "bad").otherwise(F.concat(F.lit("2023-01-"), F.lpad((1 + F.col("doc_id") % 40).cast("string"), 2, "0"))).alias("b"))
    fixed = readers.repair_columns(raw, {"a": "double", "b": "date"})
    return fixed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("numbers"), F.count("b").alias("dates"))


@query("pr8_pr9_columns_by_type", f"SELECT {', '.join(f'{R(f'avg({c})', 4)} AS {c}' for c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))}, "
       "count(DISTINCT l_returnflag) AS l_returnflag, count(DISTINCT l_linestatus) AS l_linestatus FROM lineitem")
def pr8(t: Tables):
    li = t.lineitem
    num = names.numeric_columns(li, ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    txt = names.text_columns(li)
    return li.agg(*[rnd(F.avg(c), 4).alias(c) for c in num], *[F.countDistinct(c).alias(c) for c in txt])


# ---- filters and validation --------------------------------------------------------------

TARGETS = f"""WITH {v.MEMBERS}, {v.REPORTS}, {v.CALENDAR}, {v.SPINE},
dated AS MATERIALIZED (SELECT s.company_id, s.timestamp, min(reported_at) - s.timestamp AS dur FROM spine s LEFT JOIN reports r ON s.company_id = r.company_id
  AND r.reported_at BETWEEN s.timestamp AND s.timestamp + INTERVAL 90 DAY GROUP BY s.company_id, s.timestamp),
tgt AS (SELECT company_id, timestamp, CAST(dur IS NOT NULL AS INT) AS event, coalesce(dur, 90) AS duration,
  CASE WHEN CAST(company_id AS BIGINT) % 11 <> 0 THEN CAST(company_id AS BIGINT) % 5 END AS is_registered FROM dated)"""


def _targets(t: Tables):
    from .q_spine import _calendar

    dated = labels.member_first_reports(_calendar(t), v.members(t), v.reports(t))
    tgt = labels.event_targets(dated.withColumn("duration", labels.whole_days("first_report_at", "timestamp"))).drop("first_report_at")
    key = F.col("company_id").cast("long")
    return tgt.withColumn("is_registered", F.when(key % 11 != 0, key % 5))


@query("fl1_preprocess", f"{TARGETS} SELECT company_id, timestamp, event, duration, is_registered FROM tgt WHERE duration > 0 AND is_registered IS NOT NULL")
def fl1(t: Tables):
    return validate.preprocess_dataset(_targets(t), "duration", ["is_registered", "event"])


@query("fl2_fl3_period_split", f"""SELECT CASE WHEN d BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' THEN 'train' WHEN d BETWEEN DATE '1998-01-01' AND DATE '1999-06-30' THEN 'test'
  WHEN d BETWEEN DATE '1999-07-01' AND DATE '2000-06-30' THEN 'validation' ELSE 'scoring' END AS split, count(*) AS n, {R('avg(o_totalprice)', 4)} AS mean_price
FROM (SELECT CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS d, o_totalprice FROM orders) GROUP BY 1""")
def fl2(t: Tables):
    from datetime import date

    d = t.orders.withColumn("d", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate").cast("date")))
    split = validate.split_periods("d", {"train": (date(1995, 1, 1), date(1997, 12, 31)), "test": (date(1998, 1, 1), date(1999, 6, 30)),
                                         "validation": (date(1999, 7, 1), date(2000, 6, 30))}, "scoring")
    return d.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("fl5_not_subtask", """SELECT c_mktsegment, count(CASE WHEN NOT (x = 1) OR (x = 1) IS NULL THEN 1 END) AS null_safe, count(CASE WHEN x <> 1 THEN 1 END) AS plain
FROM (SELECT c_mktsegment, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 2 END AS x FROM customer) GROUP BY 1""")
def fl5(t: Tables):
    d = t.customer.withColumn("x", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 2))
    return d.groupBy("c_mktsegment").agg(F.count_if(~F.col("x").eqNullSafe(1)).alias("null_safe"), F.count_if(F.col("x") != 1).alias("plain"))


@query("fl6_membership", f"""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY 1""")
def fl6(t: Tables):
    rich = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(rich, "o_custkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("fl7_drop_missing", """SELECT lang, count(*) AS n FROM (SELECT lang, nullif(doc_id % 6, 0) AS a, nullif(doc_id % 4, 0) AS b FROM documents)
WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def fl7(t: Tables):
    d = t.documents.select("lang", F.nullif(F.col("doc_id") % 6, F.lit(0)).alias("a"), F.nullif(F.col("doc_id") % 4, F.lit(0)).alias("b"))
    return d.dropna(subset=["a", "b"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("fl8_validation_rules", f"""{TARGETS} SELECT unnest(['missing_columns', 'feature_type', 'label_type', 'unexpected_nulls', 'event_not_binary', 'duration_not_integral', 'duration_out_of_range']) AS rule,
  unnest([1, 1, 0, count(CASE WHEN is_registered IS NULL THEN 1 END), 0, 0, count(CASE WHEN duration NOT BETWEEN 1 AND 90 THEN 1 END)]) AS violations FROM tgt""")
def fl8(t: Tables):
    return validate.validation_report(_targets(t), ["company_id", "event", "duration", "is_registered", "mkyc_ind"], [],
                                      ["is_registered", "company_id"], "event", "duration")


@query("fl9_null_rates", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {R(f'avg(CASE WHEN nullif({e}, 0) IS NULL THEN 1 ELSE 0 END)', 6)} AS null_rate FROM lineitem"
    for c, e in (("a", "l_linenumber % 3"), ("b", "l_suppkey % 10"), ("c", "l_orderkey % 2"))))
def fl9(t: Tables):
    d = t.lineitem.select(*[F.nullif(F.expr(e), F.lit(0)).alias(c) for c, e in (("a", "l_linenumber % 3"), ("b", "l_suppkey % 10"), ("c", "l_orderkey % 2"))])
    return validate.null_rates(d).withColumn("null_rate", rnd("null_rate", 6))


# ---- joins -------------------------------------------------------------------------------

@query("jn1_key_chain", f"""SELECT r_name, n_name, count(*) AS lines, {R('sum(l_extendedprice)', 2)} AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def jn1(t: Tables):
    # value per order first: the chain then joins one row per order, not per line
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_extendedprice").alias("value"))
    j = (per_order.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
         .join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
         .join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")))
    return j.groupBy("r_name", "n_name").agg(F.sum("lines").alias("lines"), rnd(F.sum("value"), 2).alias("value"))


@query("jn2_left_made_inner", """SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_custkey) AS companies FROM customer LEFT JOIN orders ON c_custkey = o_custkey
WHERE o_orderstatus IN ('F', 'P') GROUP BY 1""")
def jn2(t: Tables):
    moved = t.orders.where(F.col("o_orderstatus").isin("F", "P")).select("o_custkey")
    return t.customer.join(moved, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("companies"))


@query("jn3_left_with_predicate", """SELECT c_custkey, count(o_orderkey) AS urgent, max(CAST(o_orderdate AS DATE)) AS last_urgent FROM customer
LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def jn3(t: Tables):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("urgent"), F.max(F.col("o_orderdate").cast("date")).alias("last_urgent"))
    return t.customer.select("c_custkey").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("urgent", F.lit(0)).alias("urgent"), "last_urgent")


# Tickets stand-in: an order is a ticket, its parent the order with a tenth of the key.
TICKETS = """tickets AS (SELECT CAST(o_orderkey AS VARCHAR) AS ticket_key, o_orderkey AS ticket_id,
    CASE WHEN o_orderkey % 3 = 0 AND o_orderkey > 0 THEN CAST(o_orderkey // 10 AS VARCHAR) END AS parent_key,
    CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE 'AC' END AS project_key, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS company_id,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS date_of_report,
    CASE WHEN o_orderkey % 6 <> 0 THEN (['Purchase scam', 'Mule', 'Other', 'Weather', 'HMRC scam', 'Invoice scams'])[1 + o_orderkey % 6] END AS fraud_type,
    CASE WHEN o_orderkey % 9 = 0 THEN 'Duplicate' ELSE 'Open' END AS ticket_status, nullif(o_orderkey % 5, 4) AS number_of_reports,
    CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderkey % 2 = 0 AS INT) END AS is_subtask,
    o_orderdate AS ticket_created_at, ' "T' || (o_orderkey % 5000) || '", ' AS ref_one,
    CASE WHEN o_orderkey % 2 = 0 THEN 'T' || ((o_orderkey * 7) % 5000) || ']' END AS ref_two,
    CASE WHEN o_orderkey % 3 = 0 THEN 'T' || (o_orderkey % 5000) END AS ref_three FROM orders)"""
CHANGES = """changes AS (SELECT l_orderkey AS ticket_id, CASE WHEN l_linenumber % 2 = 0 THEN 'Number of fraud reports' ELSE 'status' END AS change_field,
    l_shipdate AS change_at FROM lineitem)"""
CASH = """cash AS (SELECT 'T' || event_id AS txn_ref, CASE WHEN event_id % 2 = 0 THEN -value ELSE value END AS amount, ts AS transaction_at, CAST(user_id AS VARCHAR) AS company_id
    FROM events)"""
REFS = ["ref_one", "ref_two", "ref_three"]
CLEANED = r"""regexp_replace(trim({c}), '[\s,"\]]', '', 'g')"""
REF_ROWS = "refs AS (" + " UNION ".join(
    f"SELECT ticket_key, {CLEANED.format(c=c)} AS txn_ref FROM tickets WHERE {c} IS NOT NULL" for c in REFS) + ")"


def _tickets(t: Tables):
    k = F.col("o_orderkey")
    kinds = F.array(*[F.lit(x) for x in ("Purchase scam", "Mule", "Other", "Weather", "HMRC scam", "Invoice scams")])
    tref = lambda e: F.concat(F.lit("T"), e.cast("string"))
    return t.orders.select(
        k.cast("string").alias("ticket_key"), k.alias("ticket_id"),
        F.when((k % 3 == 0) & (k > 0), F.floor(k / 10).cast("long").cast("string")).alias("parent_key"),
        F.when(k % 4 == 0, "X").otherwise("AC").alias("project_key"),
        F.when(k % 5 != 0, F.col("o_custkey").cast("string")).alias("company_id"),
        F.when(k % 7 != 0, F.col("o_orderdate").cast("date")).alias("date_of_report"),
        F.when(k % 6 != 0, F.get(kinds, (k % 6).cast("int"))).alias("fraud_type"),
        F.when(k % 9 == 0, "Duplicate").otherwise("Open").alias("ticket_status"),
        F.nullif(k % 5, F.lit(4)).alias("number_of_reports"),
        F.when(k % 8 != 0, (k % 2 == 0).cast("int")).alias("is_subtask"), F.col("o_orderdate").alias("ticket_created_at"),
        F.concat(F.lit(' "'), tref(k % 5000), F.lit('", ')).alias("ref_one"),
        F.when(k % 2 == 0, F.concat(tref((k * 7) % 5000), F.lit("]"))).alias("ref_two"),
        F.when(k % 3 == 0, tref(k % 5000)).alias("ref_three"))


def _cash(t: Tables):
    return t.events.select(F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("txn_ref"),
                           F.when(F.col("event_id") % 2 == 0, -F.col("value")).otherwise(F.col("value")).alias("amount"),
                           F.col("ts").alias("transaction_at"), F.col("user_id").cast("string").alias("company_id"))


def _changes(t: Tables):
    return t.lineitem.select(F.col("l_orderkey").alias("ticket_id"),
                             F.when(F.col("l_linenumber") % 2 == 0, "Number of fraud reports").otherwise("status").alias("change_field"),
                             F.col("l_shipdate").alias("change_at"))


@query("jn4_parent_ticket", f"""WITH {TICKETS} SELECT a.ticket_key, coalesce(a.company_id, b.company_id) AS company_id,
  coalesce(a.date_of_report, b.date_of_report) AS date_of_report, coalesce(a.parent_key, a.ticket_key) AS case_key
FROM tickets a LEFT JOIN tickets b ON a.parent_key = b.ticket_key""")
def jn4(t: Tables):
    return tickets.with_parent(_tickets(t), ["company_id", "date_of_report"]).select("ticket_key", "company_id", "date_of_report", "case_key")


@query("jn5_clean_reference_join", f"""WITH {TICKETS}, {CASH} SELECT ticket_key, c.txn_ref, c.amount FROM tickets JOIN cash c
  ON {CLEANED.format(c='ref_one')} = c.txn_ref""")
def jn5(t: Tables):
    refs = _tickets(t).select("ticket_key", tickets.clean_reference("ref_one").alias("txn_ref"))
    return refs.join(_cash(t).select("txn_ref", "amount"), "txn_ref")


@query("st2_reference_rows", f"WITH {TICKETS}, {REF_ROWS} SELECT ticket_key, txn_ref FROM refs")
def st2(t: Tables):
    return tickets.reference_rows(_tickets(t), "ticket_key", REFS)


@query("wn1_first_ticket", f"""WITH {TICKETS}, {REF_ROWS} SELECT txn_ref, ticket_key FROM (
  SELECT txn_ref, ticket_key, row_number() OVER (PARTITION BY txn_ref ORDER BY ticket_created_at, ticket_key) AS rn FROM tickets JOIN refs USING (ticket_key)) WHERE rn = 1""")
def wn1(t: Tables):
    tk = _tickets(t)
    rows = tk.select("ticket_key", "ticket_created_at").join(tickets.reference_rows(tk, "ticket_key", REFS), "ticket_key")
    return tickets.first_ticket_per_transaction(rows).select("txn_ref", "ticket_key")


VICTIM_CASE = "CASE " + " ".join(f"WHEN fraud_type = '{a}' THEN '{b}'" for a, b in tickets.PERPETRATOR_TYPES.items()) + " ELSE fraud_type END"
ALLOWED = ", ".join(f"'{x}'" for x in sorted(set(tickets.PERPETRATOR_TYPES.values())))


@query("lb11_victim_transactions", f"""WITH {TICKETS}, {CASH}, {REF_ROWS}, j AS (
  SELECT coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.parent_key, a.ticket_key) AS ticket_key, coalesce(a.date_of_report, b.date_of_report) AS date_of_report,
    coalesce(a.fraud_type, b.fraud_type) AS fraud_type, c.txn_ref, abs(c.amount) AS amount, c.transaction_at,
    row_number() OVER (PARTITION BY c.txn_ref ORDER BY a.ticket_created_at, a.ticket_key) AS rn
  FROM tickets a JOIN refs r ON a.ticket_key = r.ticket_key LEFT JOIN tickets b ON a.parent_key = b.ticket_key JOIN cash c ON r.txn_ref = c.txn_ref
  WHERE a.project_key = 'AC')
SELECT * EXCLUDE (rn) FROM (SELECT *, {VICTIM_CASE} AS mapped_fraud_type FROM j WHERE rn = 1)
WHERE date_of_report BETWEEN DATE '1995-06-01' AND DATE '2000-12-31' AND mapped_fraud_type IN ({ALLOWED})""")
def lb11(t: Tables):
    from datetime import date

    return tickets.victim_transactions(_tickets(t), _cash(t).drop("company_id"), REFS, "AC", date(1995, 6, 1), date(2000, 12, 31), tickets.PERPETRATOR_TYPES)


@query("lb12_perpetrator_transactions", f"""WITH {TICKETS}, {CASH}, {CHANGES}, {REF_ROWS},
rep AS (SELECT ticket_key, company_id, ticket_id, min(event_at) AS reported_date FROM (
    SELECT k.*, coalesce(change_at, ticket_created_at) AS event_at FROM tickets k LEFT JOIN changes c ON k.ticket_id = c.ticket_id AND change_field = 'Number of fraud reports'
    WHERE project_key = 'AC' AND number_of_reports IS NOT NULL AND is_subtask <> 1 AND fraud_type IN ({', '.join(f"'{x}'" for x in tickets.PERPETRATOR_TYPES)})
      AND ticket_status NOT IN ('Duplicate', 'Duplicates') AND CAST(coalesce(change_at, ticket_created_at) AS DATE) BETWEEN DATE '1995-06-01' AND DATE '2001-12-31')
  GROUP BY 1, 2, 3 HAVING min(event_at) BETWEEN DATE '1995-06-01' AND DATE '2001-12-31'),
f AS (SELECT c.company_id AS own_company, coalesce(a.company_id, c.company_id) AS company_id, coalesce(a.parent_key, a.ticket_key) AS ticket_key, CASE WHEN a.parent_key IS NULL THEN a.fraud_type ELSE s.fraud_type END AS fraud_type,
    c.txn_ref, c.transaction_at, c.amount, row_number() OVER (PARTITION BY c.txn_ref ORDER BY a.ticket_created_at, a.ticket_key) AS rn
  FROM tickets a JOIN refs r ON a.ticket_key = r.ticket_key JOIN cash c ON r.txn_ref = c.txn_ref LEFT JOIN tickets s ON a.parent_key = s.ticket_key
  WHERE a.project_key = 'AC' AND year(c.transaction_at) = 2024),
m AS (SELECT f.*, CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS manual_kyc, c_mktsegment AS risk_rating,
    c_custkey % 2 = 0 AS is_registered, c_nationkey AS industry, substr(c_name, 1, 8) AS marketing_channel, c_custkey % 5 AS risk_band
  FROM f LEFT JOIN customer ON f.own_company = CAST(c_custkey AS VARCHAR) WHERE rn = 1)
SELECT m.company_id, m.ticket_key, txn_ref, transaction_at, amount, fraud_type, risk_rating, is_registered, industry, marketing_channel, risk_band, manual_kyc, mapped_fraud_type
FROM (SELECT *, {VICTIM_CASE} AS mapped_fraud_type FROM m) m JOIN rep USING (ticket_key) WHERE mapped_fraud_type IN ({ALLOWED})""")
def lb12(t: Tables):
    from datetime import date

    c = t.customer
    companies = c.select(F.col("c_custkey").cast("string").alias("company_id"), F.col("c_custkey").alias("member_id"),
                         (F.col("c_custkey") % 2 == 0).alias("is_registered"), F.col("c_nationkey").alias("industry"))
    members = c.select(F.col("c_custkey").alias("member_id"), F.when(F.col("c_custkey") % 3 == 0, "address,name").otherwise("").alias("manual_approval_triggers"),
                       F.col("c_mktsegment").alias("risk_rating"), F.substring("c_name", 1, 8).alias("marketing_channel"), (F.col("c_custkey") % 5).alias("risk_band"))
    return tickets.perpetrator_transactions(_tickets(t), _changes(t), _cash(t), companies, members, REFS, "AC", "Number of fraud reports",
                                            date(1995, 6, 1), date(2001, 12, 31), 2024, company_columns=("is_registered", "industry"),
                                            member_columns=("marketing_channel", "risk_band"))


@query("jn9_labels_to_features", f"""{TARGETS} SELECT t.company_id, t.timestamp, t.event, o.n_orders FROM tgt t LEFT JOIN (
  SELECT CAST(o_custkey AS VARCHAR) AS company_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS timestamp, count(*) AS n_orders FROM orders GROUP BY 1, 2) o USING (company_id, timestamp)""")
def jn9(t: Tables):
    f = t.orders.groupBy(F.col("o_custkey").cast("string").alias("company_id"), F.trunc("o_orderdate", "month").alias("timestamp")).agg(F.count(F.lit(1)).alias("n_orders"))
    return _targets(t).select("company_id", "timestamp", "event").join(f, ["company_id", "timestamp"], "left")


@query("jn11_feature_blocks", f"""SELECT company_id, n_orders, n_late, {R('total', 2)} AS total FROM (SELECT o_custkey AS company_id, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY 1)
JOIN (SELECT o_custkey AS company_id, count(*) AS n_late FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1) USING (company_id)""")
def jn11(t: Tables):
    late = F.count_if(F.col("o_orderdate") >= "1998-01-01")
    return t.orders.groupBy(F.col("o_custkey").alias("company_id")).agg(F.count(F.lit(1)).alias("n_orders"), late.alias("n_late"), rnd(F.sum("o_totalprice"), 2).alias("total")).where("n_late > 0")


@query("jn12_enrichment", f"""SELECT s_suppkey, n_name, {R('s_acctbal', 2)} AS balance FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey""")
def jn12(t: Tables):
    even = t.nation.where("n_nationkey % 2 = 0")
    return t.supplier.join(F.broadcast(even), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", rnd("s_acctbal", 2).alias("balance"))


# the pair of columns is the key of the targets, so the join back is one row to one
@query("jn13_prediction_back_join", f"""{TARGETS} SELECT company_id, timestamp, event, CAST((CAST(company_id AS BIGINT) * 31 + month(timestamp)) % 100 / 100.0 AS DOUBLE) AS probability FROM tgt""")
def jn13(t: Tables):
    tgt = _targets(t)
    p = tgt.select("company_id", "timestamp", ((F.col("company_id").cast("long") * 31 + F.month("timestamp")) % 100 / 100.0).alias("probability"))
    return tgt.select("company_id", "timestamp", "event").join(p, ["company_id", "timestamp"])


@query("jn14_not_captured", """SELECT c_mktsegment, count(DISTINCT c_custkey) AS missing FROM customer WHERE c_custkey NOT IN (
  SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '2000-01-01') GROUP BY 1""")
def jn14(t: Tables):
    seen = t.orders.where("o_orderstatus = 'F' and o_orderdate >= '2000-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(seen, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.countDistinct("c_custkey").alias("missing"))


CODES = ", ".join(f"'{a}'" for a in prefix.AREA_CODES)


@query("jn15_area_code", f"""SELECT doc_id, CASE WHEN substr(p, 1, 2) IN ({CODES}) THEN substr(p, 1, 2) WHEN substr(p, 1, 1) IN ({CODES}) THEN substr(p, 1, 1) END AS area
FROM (SELECT doc_id, upper(substr(url, 9 + CAST(page_id % 9 AS INT), 4)) AS p FROM (SELECT page_id AS doc_id, page_id, url FROM pages))""")
def jn15(t: Tables):
    p = t.pages.select(F.col("page_id").alias("doc_id"), F.upper(F.substring(F.col("url"), F.lit(9) + (F.col("page_id") % 9).cast("int"), F.lit(4))).alias("p"))
    return p.select("doc_id", prefix.area_code("p").alias("area"))


@query("jn15_longest_prefix", """SELECT event_id, max_by(prefix, n) AS matched, max(n) AS n
FROM events LEFT JOIN (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS prefix, length(CAST(o_custkey AS VARCHAR)) AS n FROM orders WHERE o_custkey % 3 = 0)
ON starts_with(CAST(event_id AS VARCHAR), prefix) GROUP BY 1""")
def jn15_general(t: Tables):
    ids = t.events.select("event_id", F.col("event_id").cast("string").alias("code"))
    table = t.orders.where("o_custkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("prefix"))
    return prefix.longest_prefix_join(ids, "code", table, "prefix").select("event_id", "matched", F.length("matched").cast("long").alias("n"))


SPLIT_SQL = f"""per AS (SELECT o_custkey AS company_id, max(CAST(o_totalprice > 480000 AS INT)) AS y FROM orders GROUP BY 1),
asg AS (SELECT company_id, y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY {MIX.format(id='company_id', seed=11)}, company_id)
  <= floor(count(*) OVER (PARTITION BY y) * 0.25 + 1e-9) THEN 'test' ELSE 'train' END AS split FROM per)"""


@query("jn16_company_split", f"WITH {SPLIT_SQL} SELECT o_orderkey, o_custkey AS company_id, split FROM orders JOIN asg ON o_custkey = company_id")
def jn16(t: Tables):
    d = t.orders.select("o_orderkey", F.col("o_custkey").alias("company_id"), (F.col("o_totalprice") > 480000).cast("int").alias("y"))
    return splits.company_split(d, "company_id", "y", 0.25, 11).select("o_orderkey", "company_id", "split")


# ---- aggregates --------------------------------------------------------------------------

@query("ag1_ag2_ag3_first_event", """SELECT CAST(o_custkey AS VARCHAR) AS company_id, min(CAST(date_trunc('day', o_orderdate) AS DATE)) AS first_day, count(*) AS n
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING min(o_orderdate) >= DATE '1995-03-01' AND count(*) > 1""")
def ag2(t: Tables):
    return (v.reports(t).groupBy("company_id").agg(F.min("reported_at").alias("first_day"), F.count(F.lit(1)).alias("n"))
            .where("first_day >= date'1995-03-01' and n > 1"))


@query("ag4_keep_first", """SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def ag4(t: Tables):
    return labels.first_per_key(t.orders, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("ag5_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def ag5(t: Tables):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_discount").distinct()


@query("ag7_frequency_weights", f"""SELECT o_orderkey, {R('1.0 / n', 8)} AS w_inverse, {R('m / n', 8)} AS w_mean FROM (
  SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, (SELECT count(*) / count(DISTINCT o_custkey) FROM orders) AS m FROM orders)""")
def ag7(t: Tables):
    from ..operators import weights

    w = weights.frequency_weights(t.orders, "o_custkey")
    return w.select("o_orderkey", rnd("w_inverse", 8).alias("w_inverse"), rnd("w_mean", 8).alias("w_mean"))


@query("ag8_size_frequency", "SELECT n AS group_size, count(*) AS companies FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def ag8(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("group_size")).groupBy("group_size").agg(F.count(F.lit(1)).alias("companies"))


@query("ag9_means_and_spreads", f"SELECT l_returnflag, {R('avg(l_quantity)', 6)} AS mean_q, {R('stddev_samp(l_quantity)', 6)} AS std_q, {R('avg(CAST(l_discount > 0.05 AS INT))', 6)} AS rate FROM lineitem GROUP BY 1")
def ag9(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(rnd(F.avg("l_quantity"), 6).alias("mean_q"), rnd(F.stddev_samp("l_quantity"), 6).alias("std_q"),
                                                  rnd(F.avg((F.col("l_discount") > 0.05).cast("int")), 6).alias("rate"))


WX = "CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END"


@query("ag10_ag11_weighted_moments", f"""WITH d AS (SELECT l_linestatus, {WX} AS x, l_quantity AS w FROM lineitem), m AS (
  SELECT l_linestatus, avg(x) AS mean_x, sum(x * w) / sum(CASE WHEN x IS NOT NULL THEN w END) AS wmean, sum(x * x * w) / sum(CASE WHEN x IS NOT NULL THEN w END) AS wsq FROM d GROUP BY 1)
SELECT l_linestatus, {R('mean_x', 6)} AS mean_x, {R('wmean', 6)} AS weighted_mean, {R('sqrt(wsq - wmean * wmean)', 6)} AS weighted_std FROM m""")
def ag10(t: Tables):
    d = t.lineitem.select("l_linestatus", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("x"), F.col("l_quantity").alias("w"))
    x, w = F.col("x"), F.col("w")
    return d.groupBy("l_linestatus").agg(rnd(F.avg(x), 6).alias("mean_x"), rnd(profile.weighted_mean(x, w), 6).alias("weighted_mean"), rnd(profile.weighted_std(x, w), 6).alias("weighted_std"))


@query("ag12_capture_ratio", f"""SELECT c_mktsegment, count(DISTINCT c_custkey) AS companies, count(DISTINCT CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN c_custkey END) AS captured,
  {R("count(DISTINCT CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN c_custkey END) / count(DISTINCT c_custkey)", 6)} AS ratio FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def ag12(t: Tables):
    # one row per company first: the distinct counts become plain counts
    hit = F.max(((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000)).cast("int"))
    per = t.orders.groupBy("o_custkey").agg(hit.alias("hit"))
    return (t.customer.join(per, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment")
            .agg(F.count(F.lit(1)).alias("companies"), F.sum("hit").alias("captured"), rnd(F.avg("hit"), 6).alias("ratio")))


@query("ag13_class_profile", " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS \"column\", {R(f'avg({c})', 6)} AS mean FROM lineitem GROUP BY 1" for c in ("l_quantity", "l_discount", "l_tax")))
def ag13(t: Tables):
    return profile.class_profile(t.lineitem, "l_returnflag", ["l_quantity", "l_discount", "l_tax"]).withColumn("mean", rnd("mean", 6))


@query("ag14_target_by_keys", f"SELECT l_returnflag, l_linestatus, CAST(sum(y) AS BIGINT) AS positives, {R('avg(y)', 6)} AS rate FROM (SELECT *, CAST(l_discount > 0.07 AS INT) AS y FROM lineitem) GROUP BY 1, 2")
def ag14(t: Tables):
    y = (F.col("l_discount") > 0.07).cast("int")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum(y).alias("positives"), rnd(F.avg(y), 6).alias("rate"))


@query("ag15_count_per_date", "SELECT CAST(o_orderdate AS DATE) AS timestamp, count(o_custkey) AS n FROM orders GROUP BY 1")
def ag15(t: Tables):
    return t.orders.groupBy(F.col("o_orderdate").cast("date").alias("timestamp")).agg(F.count("o_custkey").alias("n"))


@query("ag16_describe", f"SELECT o_orderstatus, count(o_totalprice) AS count, {R('avg(o_totalprice)', 4)} AS mean, {R('stddev_samp(o_totalprice)', 4)} AS std, min(o_totalprice) AS min, max(o_totalprice) AS max, "
       + ", ".join(R(f"quantile_cont(o_totalprice, {p})", 4) + f" AS q{int(round(p * 100)):03d}" for p in profile.GRID) + " FROM orders GROUP BY 1")
def ag16(t: Tables):
    d = profile.describe(t.orders, "o_totalprice", ["o_orderstatus"])
    return d.select("o_orderstatus", "count", *[rnd(c, 4).alias(c) for c in d.columns if c in ("mean", "std") or c.startswith("q")], "min", "max")


@query("ag17_level_shares", f"SELECT o_orderpriority, count(*) AS n, {R('round_even(count(*) * 100 / sum(count(*)) OVER (), 2)', 2)} AS pct FROM orders GROUP BY 1")
def ag17(t: Tables):
    return profile.level_shares(t.orders, "o_orderpriority").withColumn("pct", rnd("pct", 2))


RATED = """rated AS (SELECT *, CASE WHEN p <= 0.3 THEN 'Low' WHEN p >= 0.7 THEN 'High' ELSE 'Medium' END AS risk_level FROM (
  SELECT o_orderdate, CAST(o_orderstatus = 'F' AS INT) AS event, ((o_orderkey % 1000003) * 7919 % 1000003) / 1000003.0 AS p FROM orders))"""


def _rated(t: Tables):
    from ..functions.hashing import portable_fraction

    d = t.orders.select("o_orderdate", (F.col("o_orderstatus") == "F").cast("int").alias("event"), portable_fraction("o_orderkey").alias("p"))
    return d.withColumn("risk_level", F.when(F.col("p") <= 0.3, "Low").when(F.col("p") >= 0.7, "High").otherwise("Medium"))


@query("ag18_event_rate_by_level", f"WITH {RATED} SELECT risk_level, {R('avg(event) * 100', 3)} AS event_rate FROM rated GROUP BY 1")
def ag18(t: Tables):
    return _rated(t).groupBy("risk_level").agg(rnd(F.avg("event") * 100, 3).alias("event_rate"))


def _trend_sql() -> str:
    cols = [f"{fn} AS {n}_{lv.lower()}" for lv in ("High", "Medium", "Low") for n, fn in (
        ("share", f"count(CASE WHEN risk_level = '{lv}' THEN 1 END) * 100.0 / count(*)"),
        ("rate", f"coalesce(avg(CASE WHEN risk_level = '{lv}' THEN event END) * 100.0, 0.0)"))]
    names_ = [f"{n}_{lv}" for lv in ("high", "medium", "low") for n in ("share", "rate")]
    line = lambda name, fn: f"SELECT '{name}' AS month_year, " + ", ".join(R(f"{fn}({c})", 3) + f" AS {c}" for c in names_) + " FROM m"
    return (f"WITH {RATED}, m AS (SELECT year(o_orderdate) || '_' || month(o_orderdate) AS month_year, {', '.join(cols)} FROM rated GROUP BY 1) "
            f"SELECT month_year, {', '.join(R(c, 3) + f' AS {c}' for c in names_)} FROM m UNION ALL {line('Average', 'avg')} UNION ALL {line('Std', 'stddev_samp')}")


@query("ag19_mt8_risk_trend", _trend_sql())
def ag19(t: Tables):
    d = _rated(t).withColumn("month_year", F.concat_ws("_", F.year("o_orderdate"), F.month("o_orderdate")))
    trend = profile.risk_trend(d, "month_year", "risk_level", "event", digits=9)
    return trend.select("month_year", *[rnd(c, 3).alias(c) for c in trend.columns if c != "month_year"])


@query("ag20_balanced_weights", f"""SELECT y, count(*) AS n, {R('max(total) / (2.0 * count(*))', 8)} AS w_balanced, {R('1000.0 / count(*)', 8)} AS w_thousand
FROM (SELECT CAST(l_discount > 0.07 AS INT) AS y, (SELECT count(*) FROM lineitem) AS total FROM lineitem) GROUP BY 1""")
def ag20(t: Tables):
    from ..operators import weights

    y = t.lineitem.select((F.col("l_discount") > 0.07).cast("int").alias("y"))
    w = weights.class_weights(y, "y")
    return w.select("y", "n", rnd("w_balanced", 8).alias("w_balanced"), rnd("w_thousand", 8).alias("w_thousand"))


@query("ag21_distinct_values", "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
def ag21(t: Tables):
    return t.orders.select(F.trunc("o_orderdate", "month").alias("month")).distinct()


def _profile_sql() -> str:
    def top(c: str) -> str:
        return f"(SELECT string_agg(x, '|' ORDER BY rn) FROM (SELECT CAST({c} AS VARCHAR) AS x, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rn FROM d WHERE {c} IS NOT NULL GROUP BY 1) WHERE rn <= 3)"
    num = ["p_size", "p_opt"]
    parts = [f"SELECT '{c}' AS \"column\", count({c}) AS count, {R(f'avg(CAST({c} IS NULL AS INT))', 6)} AS null_rate, "
             + ", ".join(f"{R(f'{fn}({c})', 4) if c in num else 'CAST(NULL AS DOUBLE)'} AS {n}" for n, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
             + f", {top(c)} AS top_values FROM d" for c in ("p_size", "p_opt", "p_brand", "p_type")]
    return "WITH d AS (SELECT *, nullif(p_size % 7, 3) AS p_opt FROM part) " + " UNION ALL ".join(parts)


@query("ag22_column_profile", _profile_sql())
def ag22(t: Tables):
    d = t.part.withColumn("p_opt", F.nullif(F.col("p_size") % 7, F.lit(3)))
    p = profile.column_profile(d, ["p_size", "p_opt"], ["p_brand", "p_type"]).drop("distinct_approx")
    return p.select("column", "count", rnd("null_rate", 6).alias("null_rate"), *[rnd(c, 4).alias(c) for c in ("mean", "std", "min", "max")], "top_values")


PROFILED = ["l_extendedprice", "l_quantity", "l_discount"]


@query("ag22_quantiles", "SELECT c AS \"column\", p, (SELECT count(*) FROM lineitem) AS n, TRUE AS within, TRUE AS distinct_within FROM (SELECT unnest(['l_extendedprice', 'l_quantity', 'l_discount']) AS c), (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS p)")
def ag22_quantiles(t: Tables):
    """Quantiles of sketches merged from partitions have ranks, and approximate distinct counts values, within their stated errors."""
    d = t.lineitem.select("l_returnflag", *PROFILED)
    q = profile.sketch_quantiles(profile.merge_sketches(profile.column_sketches(d, PROFILED, ("l_returnflag",))))
    long = d.select(*[F.col(c).cast("double").alias(c) for c in PROFILED]).unpivot([], PROFILED, "column", "x")
    pairs = long.groupBy("column", "x").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(q), "column")  # 15 rows
    ranks = pairs.groupBy("column", "p", "n").agg(F.sum(F.when(F.col("x") < F.col("value"), F.col("m")).otherwise(0)).alias("below"),
                                                  F.sum(F.when(F.col("x") <= F.col("value"), F.col("m")).otherwise(0)).alias("upto"), F.count(F.lit(1)).alias("exact"))
    near = profile.column_profile(d, PROFILED, []).select("column", "distinct_approx")
    error = profile.RANK_ERROR
    within = (F.col("below") / F.col("n") - error <= F.col("p")) & (F.col("p") <= F.col("upto") / F.col("n") + error)
    return ranks.join(F.broadcast(near), "column").select(
        "column", "p", "n", within.alias("within"), (F.abs(F.col("distinct_approx") - F.col("exact")) <= 0.15 * F.col("exact")).alias("distinct_within"))


# ---- windows, sorts, sets ----------------------------------------------------------------

CURVE = "curve AS (SELECT d, amount, sum(amount) OVER (ORDER BY d) AS cumulative, sum(amount) OVER (ORDER BY d) / sum(amount) OVER () AS share FROM (SELECT CAST(floor(o_totalprice / 1000) AS BIGINT) AS d, count(*) AS amount FROM orders GROUP BY 1))"


@query("wn2_capture_curve", f"WITH {CURVE} SELECT d, CAST(amount AS DOUBLE) AS amount, CAST(cumulative AS DOUBLE) AS cumulative, {R('share', 8)} AS share FROM curve")
def wn2(t: Tables):
    d = t.orders.select(F.floor(F.col("o_totalprice") / 1000).alias("d"))
    c = curves.capture_curve(d, "d")
    return c.select("d", "amount", "cumulative", rnd("share", 8).alias("share"))


KNEE = f"""k AS (SELECT mode, x, y, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS nx, (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) AS ny, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY mode)),
k2 AS (SELECT *, ny - nx AS d FROM k), k3 AS (SELECT *, coalesce(lag(d) OVER w, d) AS l, coalesce(lead(d) OVER w, d) AS r FROM k2 WINDOW w AS (PARTITION BY mode ORDER BY x)),
k4 AS (SELECT *, last_value(CASE WHEN d <= l AND d <= r THEN 0.0 WHEN d >= l AND d >= r THEN d - 1.0 / (n - 1) END IGNORE NULLS) OVER w AS thr,
  last_value(CASE WHEN d >= l AND d >= r THEN x END IGNORE NULLS) OVER w AS peak FROM k3
  WINDOW w AS (PARTITION BY mode ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT mode, arg_min(peak, x) AS knee FROM k4 WHERE d < thr AND peak IS NOT NULL GROUP BY 1"""


@query("wn3_lb10_knee_by_mode", f"""WITH g AS (SELECT o_orderstatus AS mode, CAST(floor(sqrt(o_totalprice)) AS BIGINT) AS x, count(*) AS a FROM orders GROUP BY 1, 2),
c AS (SELECT mode, x, sum(a * exp(-x / 150.0)) OVER w AS y FROM g WINDOW w AS (PARTITION BY mode ORDER BY x)), {KNEE}""")
def wn3(t: Tables):
    d = t.orders.select(F.col("o_orderstatus").alias("mode"), F.floor(F.sqrt("o_totalprice")).alias("x"))
    curve = curves.capture_curve(d, "x", F.exp(-F.col("x") / 150.0), ["mode"])
    return curves.knee_point(curve, "x", "share", ["mode"])


HIST = "hist AS (SELECT o_custkey AS company_id, o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice > 450000 AS INT) AS y, o_totalprice FROM orders)"


def _history(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("company_id"), "o_orderkey", F.col("o_orderdate").cast("date").alias("d"), (F.col("o_totalprice") > 450000).cast("int").alias("y"), "o_totalprice")


def _cut_sql(m: int) -> str:
    return f"""WITH {HIST} SELECT company_id, o_orderkey, y FROM (SELECT *, coalesce(sum(y) OVER (PARTITION BY company_id ORDER BY d, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hist) WHERE before < {m}"""


@query("wn4_cut_at_first_positive", _cut_sql(1))
def wn4(t: Tables):
    return sequence.cut_after_positive(_history(t), "company_id", ["d", "o_orderkey"], "y").select("company_id", "o_orderkey", "y")


@query("wn5_cut_at_second_positive", _cut_sql(2))
def wn5(t: Tables):
    return sequence.cut_after_positive(_history(t), "company_id", ["d", "o_orderkey"], "y", 2).select("company_id", "o_orderkey", "y")


@query("wn6_padded_sequences", f"""WITH {HIST}, r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY d DESC, o_orderkey DESC) AS rn FROM hist),
g AS (SELECT company_id, unnest(range(1, 6)) AS step FROM (SELECT DISTINCT company_id FROM hist))
SELECT g.company_id, 5 - g.step AS pos, coalesce(o_totalprice, 0) AS x0, coalesce(CAST(y AS DOUBLE), 0) AS y, CASE WHEN rn IS NULL THEN 0 ELSE 1 END AS not_padded
FROM g LEFT JOIN r ON g.company_id = r.company_id AND g.step = r.rn""")
def wn6(t: Tables):
    h = _history(t).withColumn("one", F.lit(1))
    s = sequence.padded_sequences(h, "company_id", ["d", "o_orderkey"], ["o_totalprice", "y"], "y", "o_totalprice", "one")
    return s.select("company_id", F.posexplode(F.arrays_zip("x", "y", "not_padded")).alias("pos", "s")).select(
        "company_id", "pos", F.get(F.col("s.x"), F.lit(0)).alias("x0"), F.col("s.y").alias("y"), F.col("s.not_padded").alias("not_padded"))


@query("wn7_history_shape", f"""SELECT count(*) AS companies, {R('avg(n)', 6)} AS rows_per_company, {R('1 - sum(least(n, 5)) / (count(*) * 5.0)', 6)} AS padded_share FROM (
  SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def wn7(t: Tables):
    s = sequence.history_shape(t.orders, "o_custkey")
    return s.select("companies", rnd("rows_per_company", 6).alias("rows_per_company"), rnd("padded_share", 6).alias("padded_share"))


@query("wn9_lift_table", f"""WITH {v.SUPERVISED}, d AS (SELECT *, ntile(10) OVER (ORDER BY score DESC, row_key) AS decile FROM supervised),
g AS (SELECT decile, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, min(score) AS lo, max(score) AS hi FROM d GROUP BY 1)
SELECT decile, n, positives, {R('lo', 8)} AS min_score, {R('hi', 8)} AS max_score, {R('positives / n', 6)} AS rate, {R('sum(positives) OVER (ORDER BY decile) / sum(positives) OVER ()', 6)} AS cumulative_capture,
  {R('(positives / n) / (sum(positives) OVER () / sum(n) OVER ())', 6)} AS lift FROM g""")
def wn9(t: Tables):
    l = curves.lift_table(v.supervised(t), "score", "y", "row_key")
    return l.select("decile", "n", "positives", *[rnd(c, 8).alias(c) for c in ("min_score", "max_score")], *[rnd(c, 6).alias(c) for c in ("rate", "cumulative_capture", "lift")])


@query("wn10_wn11_row_extremes", """SELECT row_id, CASE WHEN m IS NULL THEN NULL WHEN a = m THEN 'quantity' WHEN b = m THEN 'discount' ELSE 'tax' END AS largest, m AS max_value FROM (
  SELECT *, greatest(a, b, c) AS m FROM (SELECT l_orderkey * 10 + l_linenumber AS row_id, nullif(l_linenumber, 3) * 1.0 AS a, CASE WHEN l_suppkey % 4 <> 0 THEN l_discount * 40 END AS b,
    CASE WHEN l_suppkey % 5 <> 0 THEN l_tax * 50 END AS c FROM lineitem))""")
def wn10(t: Tables):
    from ..operators import payment

    d = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.nullif("l_linenumber", F.lit(3)) * 1.0).alias("a"),
                          F.when(F.col("l_suppkey") % 4 != 0, F.col("l_discount") * 40).alias("b"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_tax") * 50).alias("c"))
    return d.select("row_id", payment.argmax_label({"a": "quantity", "b": "discount", "c": "tax"}).alias("largest"), F.greatest("a", "b", "c").alias("max_value"))


@query("so1_so2_top_columns", f"""SELECT "column", {R('iv', 6)} AS score FROM (SELECT 'l_quantity' AS "column", abs(corr(l_quantity, l_extendedprice)) AS iv FROM lineitem UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem
UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem) ORDER BY iv DESC LIMIT 2""")
def so2(t: Tables):
    cols = ["l_quantity", "l_discount", "l_tax"]
    one = t.lineitem.agg(*[F.abs(F.corr(c, "l_extendedprice")).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "score").orderBy(F.desc("score")).limit(2).withColumn("score", rnd("score", 6))


@query("so3_repeatable_sample", f"SELECT row_id FROM (SELECT l_orderkey * 10 + l_linenumber AS row_id FROM lineitem) WHERE {MIX.format(id='row_id', seed=5)} / 1000003.0 < 0.05")
def so3(t: Tables):
    from ..functions.hashing import portable_fraction

    d = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    return d.where(portable_fraction("row_id", 5) < 0.05)


@query("so4_shuffle_order", f"SELECT o_orderkey, row_number() OVER (ORDER BY {MIX.format(id='o_orderkey', seed=3)}, o_orderkey) AS position FROM orders")
def so4(t: Tables):
    from ..operators.chunks import row_numbers

    d = t.orders.select("o_orderkey", splits.shuffle_key("o_orderkey", 3).alias("mix"))
    return row_numbers(d, [], ["mix", "o_orderkey"], "position").drop("mix")


@query("so5_downsample_negatives", f"""SELECT row_id, y FROM (SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST(l_discount > 0.08 AS INT) AS y FROM lineitem)
WHERE y = 1 OR {MIX.format(id='row_id', seed=9)} / 1000003.0 < 0.03""")
def so5(t: Tables):
    d = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_discount") > 0.08).cast("int").alias("y"))
    return splits.downsample(d, "y", "row_id", 0.03, 9)


@query("st1_union_all", "SELECT side, count(*) AS n FROM (SELECT 'customer' AS side, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier) GROUP BY 1")
def st1(t: Tables):
    a = t.customer.select(F.lit("customer").alias("side"), F.col("c_custkey").alias("id"))
    return a.unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("st3_set_difference", "SELECT l_partkey AS id FROM lineitem WHERE l_discount > 0.02 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def st3(t: Tables):
    a = t.lineitem.where("l_discount > 0.02").select(F.col("l_partkey").alias("id")).distinct()
    b = t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("id"))
    return a.join(b, "id", "left_anti")


@query("st4_lb9_explode_arrays", "SELECT o_custkey AS company_id, o_orderkey AS k, CAST(o_totalprice > 100000 AS INT) AS flag FROM orders WHERE o_totalprice > 100000")
def st4(t: Tables):
    packed = t.orders.groupBy(F.col("o_custkey").alias("company_id"), F.trunc("o_orderdate", "month").alias("m")).agg(
        F.collect_list(F.struct("o_orderkey", (F.col("o_totalprice") > 100000).cast("int").alias("f"))).alias("s"))
    arrays = packed.select("company_id", F.transform("s", lambda x: x["o_orderkey"]).alias("k"), F.transform("s", lambda x: x["f"]).alias("flag"))
    return labels.explode_labels(arrays, ["k", "flag"], F.col("flag") == 1)



