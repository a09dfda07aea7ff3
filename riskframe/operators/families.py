"""Rolling feature families of accounts, counterparties, payees and companies.

Input payments: account_id, counterparty, ts, amount, and deposit / withdrawal holding the
amount in that direction or null. Frames end just before the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .chunks import CHUNKS, running
from .interval import interval_join
from .rolling import Rolling, add_rolling
from .timekeys import DAY, micros

HOUR = 3600
SHORT_HOURS = (2, 4, 8, 12, 24, 48)
LONG = 60 * DAY


def account_sums(payments: DataFrame) -> DataFrame:
    """Deposit and withdrawal sums and counts over 2 to 48 hours."""
    ms = []
    for h in SHORT_HOURS:
        for flow, count_name in (("deposit", "incoming"), ("withdrawal", "outgoing")):
            ms.append(Rolling(f"{flow}s_sum_{h}h", "sum", flow, h * HOUR))
            ms.append(Rolling(f"{count_name}_payments_sum_{h}h", "count", flow, h * HOUR))
    return add_rolling(payments, ["account_id"], "ts", ms, 2 * HOUR)


def account_long(payments: DataFrame, threshold: float, days: int = 60) -> DataFrame:
    """Mean, max, count, spread and last request over the long window (``days``)."""
    span, tag = days * DAY, f"{days}days"
    ms = [Rolling(f"incoming_payments_sum_{tag}", "count", "deposit", span),
          Rolling(f"outgoing_payments_sum_{tag}", "count", "withdrawal", span)]
    for flow in ("deposit", "withdrawal"):
        ms += [Rolling(f"{flow}s_mean_{tag}", "mean", flow, span), Rolling(f"{flow}s_max_{tag}", "max", flow, span),
               Rolling(f"stddev_{flow}s_{tag}", "std", flow, span)]
    ms += [Rolling(f"outgoing_payments_over_threshold_sum_{tag}", "count", "over", span),
           Rolling("__last", "max", "request_us", span)]
    out = add_rolling(payments, ["account_id"], "ts", ms, DAY, {
        "over": F.when(F.col("withdrawal") > threshold, F.lit(1)),
        "request_us": F.when(F.col("withdrawal").isNotNull(), micros("ts"))})
    return out.withColumn(f"last_payment_request_max_{tag}", F.timestamp_micros("__last")).drop("__last")


def tester_payments(payments: DataFrame, limit: float = 1.0) -> DataFrame:
    return add_rolling(payments, ["account_id"], "ts", [Rolling("tester_payments_sum_24h", "count", "tiny", 24 * HOUR)],
                       2 * HOUR, {"tiny": F.when(F.col("amount") <= limit, F.lit(1))})


def counterparty_features(payments: DataFrame, flow: str, days: int = 60) -> DataFrame:
    """Sum, mean, max, min and count with one counterparty over 2 h, 48 h and the long window."""
    name = {"withdrawal": "withdrawals_to_cp", "deposit": "deposits_from_cp"}[flow]
    count = {"withdrawal": "payments_to_cp", "deposit": "payments_from_cp"}[flow]

    def family(tag: str, seconds: int) -> list[Rolling]:
        return [Rolling(f"{name}_{a}_{tag}", a, flow, seconds) for a in ("sum", "mean", "max", "min")] + [
            Rolling(f"{count}_sum_{tag}", "count", flow, seconds)]

    keys = ["account_id", "counterparty"]
    short = add_rolling(payments, keys, "ts", family("2h", 2 * HOUR) + family("48h", 48 * HOUR), 2 * HOUR)
    return add_rolling(short, keys, "ts", family(f"{days}days", days * DAY), DAY)


def over_threshold_features(payments: DataFrame, threshold: float, days: int = 60) -> DataFrame:
    """Count and value of payments above a threshold with one counterparty, both directions."""
    keys = ["account_id", "counterparty"]
    values = {f"{f}_over": F.when(F.col(f) > threshold, F.col(f)) for f in ("withdrawal", "deposit")}
    values["request_over_us"] = F.when(F.col("withdrawal") > threshold, micros("ts"))

    def family(tag: str, seconds: int) -> list[Rolling]:
        out = []
        for f, way in (("withdrawal", "to"), ("deposit", "from")):
            out += [Rolling(f"sum_payments_{way}_cp_over_threshold_{tag}", "count", f"{f}_over", seconds),
                    Rolling(f"sum_payments_value_{way}_cp_over_threshold_{tag}", "sum", f"{f}_over", seconds)]
        return out

    short = add_rolling(payments, keys, "ts", family("2h", 2 * HOUR) + family("48h", 48 * HOUR), 2 * HOUR, values)
    long = add_rolling(short, keys, "ts", family(f"{days}days", days * DAY)
                       + [Rolling("__last", "max", "request_over_us", days * DAY)], DAY, values)
    return long.withColumn("last_payment_request_timestamp_over_threshold", F.timestamp_micros("__last")).drop("__last")


def first_payee_rows(payments: DataFrame, keys: list[str], row_id: str, ts: str = "ts") -> DataFrame:
    """Add ``is_first``: the first row of the key tuple. The minimum is combined map-side, and
    the flag comes back by the unique row id, so no tuple's history is gathered."""
    firsts = payments.groupBy(*keys).agg(F.min(F.struct(ts, row_id)).alias("__f")).select(
        F.col(f"__f.{row_id}").alias(row_id), F.lit(1).alias("is_first"))
    return payments.join(firsts, row_id, "left").withColumn("is_first", F.coalesce("is_first", F.lit(0)))


def payee_popularity(payments: DataFrame, row_id: str = "event_id", n_chunks: int | None = CHUNKS) -> DataFrame:
    """Per row: accounts that paid the same payee before, first and last such addition."""
    flagged = first_payee_rows(payments, ["account_id", "counterparty"], row_id).withColumn("__pos", micros("ts"))
    first = F.col("is_first") == 1
    out = running(flagged, ["counterparty"], ["__pos", row_id], {
        "accounts_with_same_payee": ("count", F.when(first, F.lit(1))),
        "first_time_payee_addition": ("min", F.when(first, F.col("ts"))),
        "last_time_payee_addition": ("max", F.when(first, F.col("ts"))),
    }, inclusive=False, n_chunks=n_chunks)
    return out.drop("__pos", "is_first")


def new_payee_counts(payments: DataFrame, row_id: str = "event_id") -> DataFrame:
    """New payees of the account in the last 30 minutes, 2 and 48 hours."""
    flagged = first_payee_rows(payments, ["account_id", "counterparty"], row_id)
    ms = [Rolling(f"new_payee_count_{n}", "count", "new_payee", s)
          for n, s in (("30mins", 1800), ("2h", 2 * HOUR), ("48h", 48 * HOUR))]
    return add_rolling(flagged, ["account_id"], "ts", ms, 1800,
                       {"new_payee": F.when(F.col("is_first") == 1, F.lit(1))}).drop("is_first")


def recency_features(payments: DataFrame, threshold: float, days: int = 60) -> DataFrame:
    """Payments in and out of 9-22 h, high outgoing payments, initiation hours."""
    hour = F.hour("ts")
    pays = F.col("withdrawal").isNotNull()
    inside = hour.between(9, 21)
    values = {"out_hours": F.when(pays & ~inside, F.lit(1)), "in_hours": F.when(pays & inside, F.lit(1)),
              "high": F.when(F.col("withdrawal") > threshold, F.lit(1)), "pay_hour": F.when(pays, hour)}
    short = add_rolling(payments, ["account_id"], "ts", [
        Rolling("outgoing_payments_over_threshold_sum_2d", "count", "high", 48 * HOUR),
        Rolling("payment_initiated_hour_max_48h", "max", "pay_hour", 48 * HOUR),
        Rolling("payment_initiated_hour_min_48h", "min", "pay_hour", 48 * HOUR)], DAY, values)
    return add_rolling(short, ["account_id"], "ts", [
        Rolling(f"payments_outside_9_to_22h_{days}d", "count", "out_hours", days * DAY),
        Rolling(f"payments_inside_9_to_22h_{days}d", "count", "in_hours", days * DAY),
        Rolling(f"outgoing_payments_over_threshold_sum_{days}d", "count", "high", days * DAY)], DAY, values)


# Hours that count as late for cash, and the rounding unit of round amounts.
LATE_BEFORE, LATE_FROM, ROUND_UNIT = 6, 22, 10


def company_behaviour_measures(channel: str, amount: str, party: str, ts: str, deposit: Column,
                               channels: dict[str, str], high: float, tester: float = 1.0,
                               names: str | None = None) -> list[Column]:
    """Measures of the one-year company profile as aggregate expressions.

    ``channels`` maps the roles card, cardwtd, fast_out, ddebit, out, fast_in, cash, in to
    channel values; ``names`` is the counterparty name column for the name-matched counts.
    """
    a, ch, cp = F.col(amount), F.col(channel), F.col(party)

    def on(role: str) -> Column:
        return ch == channels[role]

    def share(role: str, side: Column) -> Column:
        return F.try_divide(F.count_if(on(role) & side), F.count_if(side))

    out_roles = {"cardpmt": "card", "fastpmt": "fast_out", "ddebit": "ddebit", "cardwtd": "cardwtd", "outpmt": "out"}
    in_roles = {"fastpmt": "fast_in", "cash": "cash", "inpmt": "in"}
    hour = F.hour(ts)
    ms = [
        F.avg(F.when(deposit, a)).alias("avg_deposit"), F.max(F.when(deposit, a)).alias("max_deposit"),
        F.avg(F.when(~deposit, a)).alias("avg_withdrawal"), F.max(F.when(~deposit, a)).alias("max_withdrawal"),
        F.avg((F.pmod(a, F.lit(float(ROUND_UNIT))) == 0).cast("int")).alias("pct_round_txns"),
        F.try_divide(F.countDistinct(a), F.count(a)).alias("pct_unique_txns"),
        F.count_if(a <= tester).alias("tester_pmt_cnt"),
        F.count_if(on("cash") & ((hour < LATE_BEFORE) | (hour >= LATE_FROM))).alias("cashtxns_latehrs"),
        *[share(r, ~deposit).alias(f"{n}_wtd_pct") for n, r in out_roles.items()],
        *[share(r, deposit).alias(f"{n}_dep_pct") for n, r in in_roles.items()],
        F.countDistinct(F.when(on("fast_out"), cp)).alias("fastpmt_beneficiaries"),
        F.countDistinct(F.when(on("fast_in"), cp)).alias("fastpmt_benefactors"),
        F.countDistinct(F.when(on("ddebit"), cp)).alias("ddebit_beneficiaries"),
        F.countDistinct(F.when(on("card"), cp)).alias("cardpmt_acceptors"),
        F.countDistinct(F.when(on("cardwtd"), cp)).alias("pos_atm_locations"),
        F.countDistinct(F.when(on("card") | on("cardwtd"), cp)).alias("card_pans_cnt"),
        F.try_divide(F.count_if(deposit), F.count_if(~deposit)).alias("deposit_wtd_frequency_ratio"),
        *[F.count_if(on(r) & (a > high)).alias(n) for n, r in (
            ("high_card_pmts", "card"), ("high_card_wtds", "cardwtd"), ("high_fpmt_out", "fast_out"),
            ("high_pmt_out", "out"), ("high_ddebit", "ddebit"), ("high_fpmt_in", "fast_in"),
            ("high_pmt_in", "in"), ("max_cash_deposits", "cash"))],
    ]
    if names:
        ms += [F.count_if(F.lower(names).contains(n)).alias(f"{n}_txns_cnt") for n in ("hmrc", "xero")]
    return ms


def company_behaviour(spine: DataFrame, transactions: DataFrame, company: str, spine_ts: str, txn_ts: str,
                      measures: list[Column], days: int = 365, bucket_days: int = 30) -> DataFrame:
    """As-of profile over (ts - days, ts), both ends open, one row per spine row.

    Bucketed equi-join, then one aggregation combined before the shuffle; distinct counts are
    expanded by the engine into partial aggregates, so a busy company is never gathered.
    """
    hits = interval_join(spine.select(company, spine_ts), transactions, company, spine_ts, txn_ts,
                         low=-days * DAY, high=0, bucket=bucket_days * DAY, low_open=True, high_open=True)
    return spine.join(hits.groupBy(company, spine_ts).agg(*measures), [company, spine_ts], "left")


def last_n_statistics(payments: DataFrame, value: str, n: int = 20, row_id: str = "event_id",
                      keys: tuple[str, ...] = ("account_id",), n_chunks: int | None = CHUNKS) -> DataFrame:
    """Mean, spread, trend, z-score and mean gap over the previous ``n`` rows that carry ``value``.

    Rows are numbered per account by the chunked scan, then cut into blocks of n numbers; a
    window over (account, block) that also sees the previous block is enough for any row.
    """
    from .chunks import row_numbers

    dated = payments.where(F.col(value).isNotNull()).withColumn("__pos", micros("ts"))
    numbered = row_numbers(dated, list(keys), ["__pos", row_id], "__rn", n_chunks=n_chunks)
    blocks = numbered.withColumn("__own", F.floor((F.col("__rn") - 1) / n)).withColumn(
        "__blk", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
    w = W.partitionBy(*keys, "__blk").orderBy("__rn").rowsBetween(-n, -1)
    v = F.col(value)
    stats = blocks.select(
        *payments.columns, "__own", "__blk",
        F.count(v).over(w).alias("n_last"), F.avg(v).over(w).alias("mean_last"), F.stddev_samp(v).over(w).alias("std_last"),
        F.regr_slope(v, F.col("__rn").cast("double")).over(w).alias("trend_last"),
        F.min("__pos").over(w).alias("__p0"), F.max("__pos").over(w).alias("__p1"),
    ).where("__own = __blk")
    # consecutive gaps telescope, so their mean is (last - first) / (n - 1)
    gap = F.try_divide((F.col("__p1") - F.col("__p0")) / 1e6, F.col("n_last") - 1)
    return stats.select(
        *payments.columns, "n_last", "mean_last", "std_last", "trend_last",
        F.try_divide(v - F.col("mean_last"), "std_last").alias("zscore_last"),
        gap.alias("mean_gap_seconds_last"),
        F.try_divide(F.col("n_last") * F.col("mean_last"), (F.col("__p1") - F.col("__p0")) / 1e6 / HOUR).alias("velocity_last"))


def mean_gap_seconds(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Mean seconds between consecutive timestamps per key: (last - first) / (n - 1)."""
    p = micros(ts)
    return df.groupBy(*keys).agg(
        F.try_divide((F.max(p) - F.min(p)) / 1e6, F.count(p) - 1).alias("mean_gap_seconds"))
