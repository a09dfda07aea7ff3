"""Hand-made edge tables for the semantics that are easy to get wrong."""

import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskframe.functions import scalars as sc
from riskframe.functions import textrow
from riskframe.operators import (
    asof, binning, calendar, curves, encode, labels, metrics, model, oversample, payment, pipeline, prefix, profile, rules, select,
    sequence, spine, splits, tickets, transactions, validate, weights,
)
from riskframe.sources import names, readers, sinks

D = date(2020, 3, 1)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# ---- calendars and spines ------------------------------------------------------------------

def test_calendar_modes(spark):
    feb = (date(2020, 2, 1), date(2020, 2, 29))
    days = [r["feature_date"] for r in calendar.feature_dates(spark, *feb, mode="random", seed=3).collect()]
    assert len(days) == 1 and days[0].month == 2
    assert days == [r["feature_date"] for r in calendar.feature_dates(spark, *feb, mode="random", seed=3).collect()]
    assert [r["feature_date"] for r in calendar.feature_dates(spark, *feb, mode="first").collect()] == [feb[0]]
    # drawn with replacement: repeats are dropped unless asked for
    many = calendar.feature_dates(spark, *feb, mode="multiple", k=60, distinct=False)
    assert many.count() == 60 and calendar.feature_dates(spark, *feb, mode="multiple", k=60).count() == many.distinct().count() <= 29
    assert calendar.months(spark, date(2019, 11, 30), date(2020, 2, 1)).count() == 4


def test_period_guard():
    calendar.check_period(date(2018, 6, 1), date(2018, 7, 1))
    for a, z in ((date(2018, 5, 31), D), (D, D)):
        with pytest.raises(ValueError):
            calendar.check_period(a, z)


def test_spine_boundaries(spark):
    before, after = D - timedelta(1), D + timedelta(1)
    rows = [("ok", 1, before, 0, None), ("on", 1, D, 0, None), ("later", 1, after, 0, None), ("rej_before", 1, before, 1, before),
            ("rej_on", 1, before, 1, D), ("rej_after", 1, before, 1, after), ("never", 0, before, 0, None)]
    m = spark.createDataFrame(rows, "company_id string, is_approved int, approved_at date, is_rejected int, rejected_at date")
    cal = spark.createDataFrame([(D,)], "feature_date date")
    assert {r["company_id"] for r in spine.member_spine(cal, m).collect()} == {"ok", "rej_after"}
    tx = spark.createDataFrame([("ok", 5.0, "Payment", before, 1), ("rej_after", 0.0, "Payment", before, 1), ("rej_after", 5.0, "Fee", before, 1),
                                ("on", 5.0, "Payment", before, 1), ("later", 5.0, "Payment", D, 1), ("never", 5.0, "Payment", before, 0)],
                               "company_id string, amount double, transactiontype string, transactiondate date, fullycleared int")
    assert {r["company_id"] for r in spine.active_member_spine(cal, m, tx).collect()} == {"ok", "on"}
    t = {r["company_id"]: r for r in spine.tenure_spine(cal, m, tx, 30).collect()}
    assert t["ok"]["is_ftt"] == 1 and t["ok"]["days_to_transact"] == 0 and t["ok"]["days_remaining"] == 29
    assert t["rej_after"]["is_ftt"] == 0 and t["rej_after"]["days_to_transact"] is None
    with pytest.raises(ValueError):
        spine.assert_unique(m.select("company_id", F.lit(D).alias("timestamp")).union(m.select("company_id", F.lit(D))))


# ---- labels --------------------------------------------------------------------------------

def test_report_window_is_closed_on_both_ends(spark):
    s = spark.createDataFrame([(c, D) for c in ("d0", "d1", "d90", "d91", "none", "two")], "company_id string, timestamp date")
    r = spark.createDataFrame([("d0", D), ("d1", D + timedelta(1)), ("d90", D + timedelta(90)), ("d91", D + timedelta(91)),
                               ("two", D + timedelta(9)), ("two", D + timedelta(4)), ("d0", D - timedelta(3))], "company_id string, reported_at date")
    dated = labels.first_report_after(s, r).withColumn("duration", labels.whole_days("first_report_at", "timestamp"))
    t = {x["company_id"]: (x["event"], x["duration"]) for x in labels.event_targets(dated).collect()}
    assert t == {"d0": (1, 0), "d1": (1, 1), "d90": (1, 90), "d91": (0, 90), "none": (0, 90), "two": (1, 4)}
    kept = validate.preprocess_dataset(labels.event_targets(dated), "duration", ["company_id"])
    assert "d0" not in {x["company_id"] for x in kept.collect()}  # duration 0 goes, 90 stays


def fraud_case(spark):
    ts = datetime(2020, 3, 1)
    s = spark.createDataFrame([(c, ts, 60) for c in ("none", "inside", "outside", "mixed", "same")], "company_id string, timestamp timestamp, days_remaining int")
    at = lambda d: ts + timedelta(days=d, hours=1)
    f = spark.createDataFrame([("inside", at(10), "a", 5.0), ("outside", at(61), "a", 7.0), ("mixed", at(40), "a", 1.0), ("mixed", at(200), "b", 2.0),
                               ("same", at(20), "x", 3.0), ("same", at(20), "y", 9.0), ("inside", ts, "now", 4.0)],
                              "company_id string, transaction_at timestamp, app_fraud_type string, amount double")
    return s, labels.spine_frauds(s, f, 60)


def test_horizon_labels_skip_policy(spark):
    s, hits = fraud_case(spark)
    arrays = labels.array_labels(s, hits).select("company_id", *labels.horizon_columns())
    a = {r["company_id"]: r for r in arrays.collect()}
    b = {r["company_id"]: r for r in labels.horizon_labels(s, hits).collect()}
    assert a["none"]["app_fraud_amount_90d"] is None and a["none"]["is_app_fraud_90d"] == 0 and a["none"]["app_fraud_type_90d"] == []
    assert (a["inside"]["is_app_fraud_30d"], a["inside"]["days_to_fraud_30d"], a["inside"]["app_fraud_amount_30d"]) == (1, 10, 5.0)
    assert a["outside"]["is_app_fraud_90d"] == 0  # beyond the days remaining
    assert a["mixed"]["is_app_fraud_30d"] == 0 and a["mixed"]["is_app_fraud_45d"] == 1 and a["mixed"]["app_fraud_amount_90d"] == 1.0
    assert a["same"]["app_fraud_amount_30d"] == 9.0 and a["same"]["app_fraud_type_30d"] == ["y"]  # larger amount wins one instant
    for c in a:
        for h in labels.HORIZONS:
            for n in ("is_app_fraud", "days_to_fraud", "app_fraud_amount"):
                assert a[c][f"{n}_{h}d"] == b[c][f"{n}_{h}d"]


def test_days_since_incorporation(spark):
    df = spark.createDataFrame([(date(2020, 1, 1), date(2020, 3, 11), D), (date(2020, 1, 1), None, D)], "i date, r date, t date")
    assert [x[0] for x in df.select(labels.days_since_incorporation("i", "r", "t")).collect()] == [70, 150]


# ---- tickets and JSON ----------------------------------------------------------------------

def test_reference_rows_and_parents(spark):
    t = spark.createDataFrame([("p", None, " T1,", None, None), ("c", "p", '"T2"', "T2", None), ("d", "gone", None, None, "c9")],
                              "ticket_key string, parent_key string, r1 string, r2 string, company_id string")
    refs = {(r["ticket_key"], r["txn_ref"]) for r in tickets.reference_rows(t, "ticket_key", ["r1", "r2"]).collect()}
    assert refs == {("p", "T1"), ("c", "T2")}
    up = {r["ticket_key"]: r["case_key"] for r in tickets.with_parent(t, ["company_id"]).collect()}
    assert up == {"p": "p", "c": "p", "d": "gone"}


def test_json_validity(spark):
    texts = ['{"a":{"b":1}}', '{"a":1', '{"a":1}{', "", "1],[2", '1,"w":2', "[]", None, ' {"a": {"b": "x"}} ']
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    assert [r[0] for r in df.select(sc.json_valid("p")).collect()] == [True, False, False, False, False, False, True, False, True]
    assert [r[0] for r in df.select(sc.json_text("p", "a.b")).collect()][::8] == ["1", "x"]


def test_cleared_transactions_switch(spark):
    import json

    sw = datetime(2021, 7, 1)
    body = {"accountId": "A", "transactionId": "T", "amount": {"value": 150, "amount": 250}, "status": "CLEARED", "creditDebitIndicator": "DEBIT",
            "creditorAccount": {"identification": " 12345699999999 "}, "proprietaryBankTransactionCode": {"code": "DOMESTIC_TRANSFER", "issuer": "H"}}
    rows = [(sw - timedelta(seconds=1), "old", json.dumps(body)), (sw, "old", json.dumps(body)), (sw, "new", json.dumps(body)),
            (sw - timedelta(seconds=1), "new", json.dumps(body)), (sw, "new", json.dumps(body | {"status": "PENDING"})), (sw, "new", "oops")]
    e = spark.createDataFrame(rows, "timestamp timestamp, event_type string, payload string")
    out = transactions.cleared_transactions(e, datetime(2021, 1, 1), datetime(2022, 1, 1), "old", "new").collect()
    assert sorted(r["requested_payment_value"] for r in out) == [1.5, 2.5]
    assert {(r["destination_account_id"], r["destination_sort_code"]) for r in out} == {("99999999", "123456")}


# ---- scalar functions ----------------------------------------------------------------------

def test_scalars(spark):
    df = spark.createDataFrame([(1,)], "x int")
    v = lambda c: df.select(c).first()[0]
    lit = F.lit
    assert [v(sc.whole_weeks(lit(d))) for d in (3.5, 10.5, 17.5, 24.5)] == [0, 2, 2, 4]  # half-even
    assert [v(prefix.area_code(lit(p))) for p in ("SW1A", "B33", "BZ9", "Q1", "ECX", "E1")] == ["SW", "B", "B", None, "EC", "E"]
    assert v(sc.first_match(lit("no id"), "[0-9]{4,}")) is None
    assert v(sc.mail_domain(lit("a@b@x#gmail.com"))) == "gmail.com"
    assert v(sc.industry_codes(lit("1, 123456,zz,62.0"))) == ["00001", "123456", "00062"]
    assert [v(sc.outward_letters(lit(p))) for p in ("sw1a 1aa", "EC2", "Error 1", None)] == ["SWA", "EC", None, None]
    assert v(sc.guarded_age(lit("2020-01-01"), lit("2002-06-01"))) is not None  # 17.6 rounds to 18
    assert v(sc.guarded_age(lit("2020-01-01"), lit("2003-01-01"))) is None
    assert v(sc.happened_before(lit(None).cast("date"), lit(D))) == 0
    assert [v(sc.risk_level(lit(1 - p), 0.005, 0.01)) for p in (0.001, 0.007, 0.02)] == ["Low", "Medium", "High"]
    assert v(sc.category_text(lit(None))) == "MISSING"  # imputed before the change of case
    assert [v(sc.word_count(lit(t))) for t in ("", "  a b\n c ", "one")] == [0, 3, 1]
    assert abs(v(sc.softmax_positive(F.array(lit(1.0), lit(3.0)))) - 1 / (1 + math.exp(-2))) < 1e-12
    assert v(sc.has_keyword(lit("The BANK, ltd"), ["bank"])) == 1 and v(sc.has_keyword(lit("banking"), ["bank"])) == 0


def test_sentences(spark):
    base = dict(company_is_registered=0.0, company_type="LTD", company_icc="retail", applicant_age_at_completion=30.9, company_age_at_timestamp=None,
                is_restricted_keyword_present=0, days_to_transact=None, applicant_years_to_id_expiry=None, is_ftt=0.0, days_to_approval=2.0, days_on_books=5.0,
                days_remaining_as_ntt_ftt=40.0, applicant_email_numeric=1, applicant_email_domain="other", applicant_device_type="ios", applicant_id_type="Passport",
                applicant_idcountry_issue="Ireland", applicant_postcode="SW", fastpmt_beneficiaries=1.0, fastpmt_benefactors=2.0, ddebit_beneficiaries=3.0, avg_deposit=9.99)
    schema = ", ".join(f"{k} {'string' if isinstance(x, str) else 'double'}" for k, x in base.items())
    row = tuple(float(x) if isinstance(x, int) else x for x in base.values())
    text = spark.createDataFrame([row], schema).select(textrow.member_sentence()).first()[0]
    # registered is tested by value, the mail flag by 0/1, and missing numbers read "unknown"
    for part in ("is not registered", "is 30 years", "business is unknown", "some numeric characters", "other than standard", "unknown years", "is 9 pounds"):
        assert part in text


# ---- payments and rules --------------------------------------------------------------------

def request(spark, **values):
    names_ = ["requested_payment_value", "rule_feature_request_timestamp", *values]
    data = [values.pop("requested_payment_value", 100.0), values.pop("rule_feature_request_timestamp", 1_000_000), *values.values()]
    names_ = ["requested_payment_value", "rule_feature_request_timestamp", *values]
    kinds = ", ".join(f"`{n}` {'string' if isinstance(x, str) else 'double'}" for n, x in zip(names_, data))
    return spark.createDataFrame([tuple(float(x) if isinstance(x, int) else x for x in data)], kinds)


def test_zero_windows_and_zero_request(spark):
    r = one(payment.preprocess(request(spark)))
    assert r["net_balance_indicator"] == 1.0 and r["cashflow_value_indicator"] == 100.0 and r["cashflow_volume_indicator"] == 1
    z = one(payment.preprocess(request(spark, requested_payment_value=0.0)))
    assert z["net_balance_indicator"] is None  # 0/0 in a window makes the indicator undefined
    assert z["payment_transfer_rate_on_cop"] is None  # logarithm of zero
    assert z["fastpmt_beneficiaries_benefactors_ratio_1y"] is None


def test_strict_greatest_and_argmax(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 2.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(payment.strict_greatest([F.col("a"), F.col("b")])).collect()] == [None, 2.0, None]
    assert [r[0] for r in df.select(payment.argmax_label({"a": "A", "b": "B"})).collect()] == ["A", "A", None]


def test_payee_age(spark):
    now = 50_000_000
    for confirmed, days, hours, new48 in ((None, 365.0, 48.0, 0.0), (0, 365.0, 48.0, 0.0), (now - 3600, 1 / 24, 1.0, 7.0), (now - 172800, 2.0, 48.0, 0.0), (now - 366 * 86400, 365.0, 48.0, 0.0)):
        r = one(payment.preprocess(request(spark, rule_feature_request_timestamp=now, timestamp_ntm_recipient_confirmed=confirmed,
                                           rolling_sum_of_withdrawals_value_to_counter_party_abv_thresh_1000_60d=7.0)))
        assert abs(r["days_since_confirmation_of_payee"] - days) < 1e-9 and r["hours_since_confirmation_of_payee"] == hours
        assert r["rolling_sum_of_pmts_over_threshold_to_new_payee_60d"] == new48  # the long output uses the 48 h rule


def test_rules(spark):
    now = 1_000_000
    rows = [("12001039", "083210", "950000", True, now + 1, 100.0, 100.0, now - 29), ("x", "y", None, True, now, 100.0, 99.0, now - 10),
            (None, None, "1100000", None, now + 9, 99.0, 100.0, now - 30), ("1", "2", "bad", False, now + 9, 500.0, 100.0, now + 50)]
    df = spark.createDataFrame([(100.0, now, *r, None, None, None, None) for r in rows],
        "requested_payment_value double, rule_feature_request_timestamp long, destination_account_number string, destination_account_sort_code string, "
        "rule_feature_permenant_clearlisting_last_whitelisted_at string, rule_feature_is_source_dest_clearlisted boolean, rule_feature_source_dest_expiry_ts long, "
        "rule_feature_source_dest_amount double, rule_feature_credit_line_amount double, rule_feature_credit_line_last_updated_at long, rule_feature_kyc_risk_band string, "
        "rule_feature_is_clearlisted boolean, rule_feature_clearlisting_last_updated_at string, rule_feature_event_ignore_expiration boolean")
    out = rules.apply_rules(df).collect()
    assert [r["rule_feature_is_recipient_account_exempted"] for r in out] == [1, 0, 0, 0]
    assert [r["rule_feature_is_clearlisted"] for r in out] == [1, 0, 0, 0]
    assert [r["rule_feature_is_source_dest_clearlisted"] for r in out] == [1, 0, 0, 0]  # expiry equal is expired
    assert [r["rule_feature_is_matching_credit_event"] for r in out] == [1, 0, 0, 1]  # 30 s is too old, a later event matches
    assert [r[0] for r in df.select(rules.matching_credit_event(bounded=True)).collect()] == [1, 0, 0, 0]
    assert out[0]["rule_feature_kyc_risk_band"] == "HIGH"


# ---- encoders ------------------------------------------------------------------------------

def test_encoders_never_refit(spark):
    a = spark.createDataFrame([(i, "ABC"[i % 3] if i < 60 else "solo", i % 2) for i in range(61)] + [(99, None, 1)], "id long, c string, y int")
    later = spark.createDataFrame([(1, "A", 0), (2, "new", 0), (3, None, 0)], "id long, c string, y int")
    te, me = encode.fit_target_encoder(a, "c", "y"), encode.fit_m_estimate(a, "c", "y")
    prior = a.agg(F.avg("y")).first()[0]
    for m, unseen in ((te, prior), (me, None)):
        alone = {r["id"]: r["c_encoded"] for r in m.transform(later).collect()}
        both = {r["id"]: r["c_encoded"] for r in m.transform(later.unionByName(a.where("id > 50"))).where("id < 10").collect()}
        assert alone == both and alone[2] == unseen and alone[3] == unseen
    assert abs({r["category"]: r["value"] for r in te.table.collect()}["solo"] - prior) < 1e-12  # a single row says nothing
    oof = encode.m_estimate_out_of_fold(a, "c", "y", "id").where("c = 'solo'").collect()
    assert [r["c_encoded"] for r in oof] == [None]  # its only row is in the held-out fold


def test_rare_and_one_hot(spark):
    a = spark.createDataFrame([("a",)] * 50 + [("b",)] * 45 + [("c",)] * 3 + [("d",)] * 2, "c string")
    assert encode.fit_rare(a, "c", 0.1, 10).frequent is None  # few categories: nothing grouped
    g = encode.fit_rare(a, "c", 0.1, 3)
    assert g.frequent == ["a", "b"]
    later = g.transform(spark.createDataFrame([("zzz",), (None,)], "c string"))
    assert [r["c"] for r in later.collect()] == ["Rare", None]
    hot = encode.fit_one_hot(a, "c")
    z = hot.transform(spark.createDataFrame([("q",), ("b",)], "c string")).collect()
    assert [list(r)[1:] for r in z] == [[0, 0, 0, 0], [0, 1, 0, 0]]
    with pytest.raises(ValueError):
        encode.fit_one_hot(a, "c", limit=3)


def test_scalers_and_noise(spark):
    df = spark.createDataFrame([(i, float(i), 5.0, 1.0) for i in range(2000)], "id long, x double, k double, w double")
    z = encode.fit_standard_scaler(df, ["x", "k"]).transform(df)
    s = z.agg(F.avg("x"), F.stddev_pop("x"), F.max("k")).first()
    assert abs(s[0]) < 1e-9 and abs(s[1] - 1) < 1e-9 and s[2] == 0.0
    noisy = encode.fit_noise(df, ["x"], "w", "id", 3.0, 1)
    d = noisy.transform(df).join(df.select("id", F.col("x").alias("x0")), "id").select((F.col("x") - F.col("x0")).alias("d"))
    r = d.agg(F.avg("d"), F.stddev_pop("d")).first()
    want = df.agg(F.stddev_pop("x")).first()[0] / 3
    assert abs(r[1] / want - 1) < 0.1 and abs(r[0]) < want / 5
    assert encode.noise_scale(0.5) == 0.5


def test_woe_bins_are_monotone_and_large(spark):
    rows = [(float(i % 100), int((i * 7919) % 100 < 10 + (i % 100) // 2), None) for i in range(20000)]
    df = spark.createDataFrame([(x, y) for x, y, _ in rows] + [(None, 1)] * 50 + [(None, 0)] * 50, "x double, y int")
    m = binning.fit_woe(df, ["x"], "y")["x"]
    assert m.edges == sorted(m.edges) and len(m.weights) == len(m.edges) + 1 <= 33
    assert m.weights == sorted(m.weights, reverse=True)  # more events, lower weight
    sizes = m.transform(df.where("x is not null")).groupBy("x_encoded").count().collect()
    assert min(r["count"] for r in sizes) >= 0.033 * 20000
    n, e = df.count(), df.agg(F.sum("y")).first()[0]
    assert abs(m.missing - math.log((50 / (n - e)) / (50 / e))) < 1e-9


def test_collinear_columns(spark):
    df = spark.range(3000).select(F.col("id").cast("double").alias("x"), (2 * F.col("id") + F.pmod(F.xxhash64("id"), F.lit(7))).cast("double").alias("x2"),
                                  F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).cast("double").alias("free"), F.lit(1.0).alias("flat"))
    kept = select.select_features(df, ["x", "x2", "free", "flat"])
    assert "free" in kept and "flat" not in kept and len(kept) == 2


def test_feature_pipeline_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b"), (3, 4.0, None)], "id long, x double, c string")
    p = pipeline.fit_features(df, ["x"], [], {"c": (0.01, 5)}, [], ["id"])
    assert p.transform(df).columns == ["id", "x", "c_a", "c_b", "c_missing"] == ["id", *p.feature_names()]


# ---- weights, splits, sequences ------------------------------------------------------------

def test_weights_and_splits(spark):
    df = spark.createDataFrame([(i, "big" if i < 30 else f"c{i}", int(i % 10 == 0), float(i), D + timedelta(i)) for i in range(60)], "id long, company string, y int, a double, d date")
    w = weights.frequency_weights(df, "company")
    assert abs(w.agg(F.sum("w_inverse")).first()[0] - 31) < 1e-9 and abs(w.agg(F.sum("w_mean")).first()[0] - 60) < 1e-9
    assert abs(weights.scaled_weights(w, "w_inverse", "a", "d").agg(F.sum("w_scaled")).first()[0] - 60) < 1e-6
    s = splits.company_split(df, "company", "y", 0.25, 1)
    assert s.count() == 60 and s.groupBy("company").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    f = splits.stratified_folds(df, ["y"], "id", 3).groupBy("y", "fold").count().collect()
    assert max(r["count"] for r in f if r["y"] == 0) - min(r["count"] for r in f if r["y"] == 0) <= 1
    assert splits.downsample(df, "y", "id", 0.03).where("y = 1").count() == 6


@pytest.mark.parametrize("n", [1, 5, 6, 12])
def test_sequences(spark, n):
    df = spark.createDataFrame([("c", i, float(i + 1), int(i == 2), 0.5, 1) for i in range(n)], "id string, t int, x double, y int, amt double, seg int")
    r = one(sequence.padded_sequences(df, "id", ["t"], ["x"], "y", "amt", "seg"))
    pad = max(5 - n, 0)
    assert [v[0] for v in r["x"]] == [0.0] * pad + [float(i + 1) for i in range(max(n - 5, 0), n)]
    assert list(r["not_padded"]) == [0] * pad + [1] * min(n, 5)


@pytest.mark.parametrize("positives,m,want", [([0], 1, 1), ([5], 1, 6), ([2, 4], 1, 3), ([2, 4], 2, 5), ([2], 2, 6), ([], 1, 6)])
def test_cut_after_positive(spark, positives, m, want):
    df = spark.createDataFrame([("c", i, int(i in positives)) for i in range(6)], "id string, t int, y int")
    assert sequence.cut_after_positive(df, "id", ["t"], "y", m).count() == want


# ---- metrics -------------------------------------------------------------------------------

@pytest.mark.parametrize("scores,want", [([1, 2, 3, 4], 1.0), ([4, 3, 2, 1], 0.0), ([1, 1, 1, 1], 0.5)])
def test_auc_ties_and_extremes(spark, scores, want):
    df = spark.createDataFrame([(float(s), y) for s, y in zip(scores, (0, 0, 1, 1))], "s double, y int")
    assert one(metrics.auc(df, "s", "y"))["auc"] == want
    assert one(metrics.auc(df.where("y = 1"), "s", "y"))["auc"] is None  # one class only


def test_threshold_and_roc(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.5, 0), (0.4, 0)], "s double, y int")
    full = metrics.roc_points(df, "s", "y", drop_collinear=False)
    assert full.count() == 6
    assert sorted(r["threshold"] for r in metrics.roc_points(df, "s", "y").collect()) == [0.4, 0.6, 0.7, 0.8, 0.9]
    assert one(metrics.threshold_at_fpr(df, "s", "y", 0.0))["threshold"] == 0.8
    assert one(metrics.threshold_at_fpr(df.where("y = 0"), "s", "y", 0.1))["threshold"] == float("inf")


def test_concordance_equals_brute_force(spark):
    few = [(1 + (i * 7) % 6, int(i % 3 != 0), float((i * 5) % 7)) for i in range(60)]
    many = [((i * 7919) % 2503, int(i % 4 != 0), float((i * 31) % 97)) for i in range(1300)]  # over 1,000 event durations
    for rows in (few, many):
        check_concordance(spark, rows)


def check_concordance(spark, rows):
    won = pairs = 0.0
    for d1, e1, r1 in rows:
        for d2, e2, r2 in rows:
            if e1 == 1 and (d2 > d1 or (d2 == d1 and e2 == 0)):
                pairs += 1
                won += 1.0 if r1 > r2 else 0.5 if r1 == r2 else 0.0
    r = one(metrics.concordance(spark.createDataFrame(rows, "d int, e int, r double"), "d", "e", "r"))
    assert (r["concordant"], r["comparable"]) == (won, pairs)


def test_knee_of_a_bend(spark):
    curve = spark.createDataFrame([(i, min(i / 20, 1.0)) for i in range(101)], "x int, y double")
    assert one(curves.knee_point(curve, "x", "y"))["knee"] == 20


def test_risk_trend_fills_missing_levels(spark):
    df = spark.createDataFrame([("2020_1", "Low", 0), ("2020_1", "High", 1), ("2020_2", "Low", 1)], "m string, lv string, e int")
    t = {r["m"]: r for r in profile.risk_trend(df, "m", "lv", "e").collect()}
    assert t["2020_2"]["share_high"] == 0 and t["2020_2"]["rate_high"] == 0 and set(t) == {"2020_1", "2020_2", "Average", "Std"}


def test_survival_models(spark):
    df = spark.createDataFrame([(1 + i % 9, int(i % 4 == 0), float(i % 3)) for i in range(300)], "d int, e int, x double")
    k = model.kaplan_meier(df, "d", "e")
    s = [r["survival"] for r in k.orderBy("duration").collect()]
    assert s == sorted(s, reverse=True) and 0 < s[-1] < 1
    m = model.fit_survival_regression(df, ["x"], "d", "e")
    p = model.survival_probability(m, df, ["x"], 5.0).agg(F.min("survival"), F.max("survival")).first()
    assert 0 < p[0] <= p[1] < 1


def test_logistic_learns_the_signs(spark):
    df = spark.range(4000).select(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 500 - 1).alias(n) for i, n in enumerate(("a", "b", "u"))])
    df = df.withColumn("y", (2 * F.col("a") - F.col("b") + F.col("u") > 0).cast("int"))
    m = model.fit_logistic(df, ["a", "b"], "y")
    assert m.coefficients[0] > 0 > m.coefficients[1]
    scored = model.score_logistic(m, df, ["a", "b"])
    assert one(metrics.auc(scored, "probability", "y"))["auc"] > 0.8
    slope, icpt = model.fit_platt(scored, "probability", "y")
    gap = scored.agg(F.avg(model.apply_platt("probability", slope, icpt)) - F.avg("y")).first()[0]
    assert abs(gap) < 0.01


# ---- oversampling --------------------------------------------------------------------------

def test_oversampling_with_copies_and_split_buckets(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    pts = [(i, [float(v) for v in rng.normal(0.5 if i % 8 == 0 else 0, 1, 4)], int(i % 8 == 0)) for i in range(240)]
    pts += [(1000 + i, [9.0, 9.0, 9.0, 9.0], 0) for i in range(160)]  # copies hold 40% of the rows
    df = spark.createDataFrame(pts, "id long, v array<double>, y int")
    p = oversample.distinct_points(df, "id", "v", "y")
    assert p.count() == 241
    exact = {(r["pid"], r["rank"]): r["other"] for r in oversample.nearest(p, 4, 5, 3).where("kind = 'all'").collect()}
    vec = {i: np.array(v) for i, v, _ in pts if i < 1000} | {1000: np.full(4, 9.0)}
    for i in (0, 8, 16, 232):
        order = sorted((j for j in vec if j != i), key=lambda j: (np.linalg.norm(vec[j] - vec[i]), j))
        assert [exact[(i, r)] for r in range(1, 6)] == order[:5]
    # forced splitting: every returned neighbour is real and ranks follow the distance
    split = oversample.nearest(p, 4, 5, 3, tables=3, bucket=40).where("kind = 'all'").collect()
    for r in split:
        assert abs(r["dist"] - np.linalg.norm(vec[r["pid"]] - vec[r["other"]])) < 1e-6
    new = oversample.borderline_oversample(df, "id", "v", "y", 4, ratio=0.2)
    need = int(0.2 * (len(pts) - 30)) - 30
    assert new.count() == need and new.where("base = other").isEmpty()


def test_neighbours_do_not_depend_on_the_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    vec = rng.normal(0, 1, (600, 12))
    y = (np.arange(600) % 6 == 0).astype(int)
    p = oversample.distinct_points(spark.createDataFrame([(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(vec, y))], "id long, v array<double>, y int"), "id", "v", "y")
    got = {(r["pid"], r["kind"], r["rank"]): r["other"] for r in oversample.nearest(p, 12, 10, 5, bucket=45).collect()}
    want = {}
    for i in np.flatnonzero(y):
        order = [int(j) for j in np.argsort(((vec - vec[i]) ** 2).sum(1)) if j != i]
        want |= {(i, "all", r + 1): j for r, j in enumerate(order[:10])} | {(i, "min", r + 1): j for r, j in enumerate([j for j in order if y[j]][:5])}
    assert got == want


@pytest.mark.parametrize("bucket", [3, 7, 4000])
def test_ties_go_by_id_at_any_cell_count(spark, bucket):
    grid = [(i, [float(i % 8), float(i // 8)], int(i % 3 == 0)) for i in range(64)]
    p = oversample.distinct_points(spark.createDataFrame(grid, "id long, v array<double>, y int"), "id", "v", "y")
    near = oversample.nearest(p, 2, 6, 4, bucket=bucket)
    got = {(r["pid"], r["kind"], r["rank"]): r["other"] for r in near.collect()}
    want = {}
    for i, v, y in grid:
        if y:
            order = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j, c) for j, w, c in grid if j != i)
            want |= {(i, "all", r + 1): j for r, (_, j, _) in enumerate(order[:6])} | {(i, "min", r + 1): j for r, (_, j, _) in enumerate([o for o in order if o[2]][:4])}
    assert got == want
    danger = {r["pid"]: r["majority"] for r in oversample.danger_points(p, near, 6).collect()}
    assert danger == {i: sum(not grid[want[i, "all", r]][2] for r in range(1, 7)) for i, _, y in grid if y}


def test_bounds_leave_few_cells():
    """On clustered points most cells are never met, and none that holds a neighbour is left out."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (100, 8)) for c in rng.uniform(-20, 20, (30, 8))])
    cells = oversample.Cells(x[::100])
    own, d = cells.own(x)
    cells.count = np.bincount(own, minlength=30)
    cells.radius = np.array([d[own == c, c].max() for c in range(30)])
    exact = np.sort(oversample._lengths(x, x), 1)[:, 10]
    reach = cells.reachable(d, exact)
    for i in range(0, len(x), 37):
        assert reach[i, own[np.argsort(oversample._lengths(x[i : i + 1], x)[0])[:11]]].all()
    pairs = (reach * cells.count).sum()
    assert pairs < 0.2 * len(x) ** 2


def test_longest_prefix_by_binary_search(spark):
    import random

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    table = {word(n) for n in range(1, 31) for _ in range(6)} | {"é漢", None, ""}
    codes = [word(rng.randint(0, 40)) for _ in range(400)] + [p + word(3) for p in table if p] + [None, "", "é漢x", "é", "\x00"]
    d = spark.createDataFrame(list(enumerate(codes)), "i int, code string")
    t = spark.createDataFrame([(p,) for p in table], "p string")
    got = prefix.longest_prefix_join(d, "code", t, "p")
    assert got.columns == ["i", "code", "matched"]
    want = {i: max((p for p in table if p and c and c.startswith(p)), key=len, default=None) for i, c in enumerate(codes)}
    assert {r["i"]: r["matched"] for r in got.collect()} == want
    assert got._jdf.queryExecution().analyzed().toString().count("Join LeftOuter") == 5


def test_one_hot_of_any_width(spark):
    d = spark.range(100_000).select(F.concat(F.lit("v"), F.col("id")).alias("c")).union(spark.createDataFrame([(None,), ("",), ("é",)], "c string"))
    words = encode.one_hot_dictionary(d, "c")
    n, low, high, distinct = words.agg(F.count("*"), F.min("place"), F.max("place"), F.countDistinct("place")).first()
    assert (n, low, high, distinct) == (100_002, 0, 100_001, 100_002)
    assert words.where("value in ('', 'v0', 'v1', 'v10', 'é')").orderBy("place").select("value").rdd.flatMap(list).collect() == ["", "v0", "v1", "v10", "é"]
    more = spark.createDataFrame([("v7",), (None,), ("new",)], "c string")
    got = {r["c"]: (len(r["c_vec"]["indices"]), r["c_vec"]["values"]) for r in encode.one_hot_vectors(more, "c", words).collect()}
    assert got == {"v7": (1, [1.0]), None: (0, []), "new": (0, [])}


def test_correlations_leave_out_pairs_not_rows(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1, (300, 4))
    x[:, 1] += x[:, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    d = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], "a double, b double, c double, d double").withColumn("e", F.lit(None).cast("double"))
    got = select.correlation_matrix(d, ["a", "b", "c", "d", "e"])
    want = pd.DataFrame(x).corr().to_numpy()
    assert np.allclose(got[:4, :4], want, atol=1e-6) and (got[4, :4] == 0).all() and got[4, 4] == 1


def test_no_fraud_is_lost_beyond_a_bound(spark):
    from datetime import datetime

    s = spark.createDataFrame([(1, datetime(2024, 1, 1), 400)], "company_id long, timestamp timestamp, days_remaining int")
    f = spark.createDataFrame([(1, datetime(2024, 12, 1), "x", 5.0)], "company_id long, transaction_at timestamp, app_fraud_type string, amount double")
    assert labels.spine_frauds(s, f, 60).count() == labels.spine_frauds(s, f).count() == 1


# ---- sources -------------------------------------------------------------------------------

def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "2020-01-02", "3.5"), (2, "bad", "x")], "id long, at string, v string")
    assert sinks.dataset_name(2018, 6, 2020, 12, "risk") == "risk_06_2018_12_2020"
    sinks.write_csv(df, str(tmp_path / "c"))
    back = readers.read_csv(spark, str(tmp_path / "c"), df.schema, timestamps={"at": "yyyy-MM-dd"})
    assert [r["at"] for r in back.orderBy("id").collect()] == [datetime(2020, 1, 2), None]
    assert [r["v"] for r in readers.repair_columns(back, {"v": "double"}).orderBy("id").collect()] == [3.5, None]
    sinks.write_dataset(df, str(tmp_path / "p"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_dataset(df, str(tmp_path / "p"))
    assert sinks.exists(spark, str(tmp_path / "p")) and not sinks.exists(spark, str(tmp_path / "none"))


def test_names():
    assert names.canonical_name("rolling_sum_features_v12__deposits_sum_2h_continuous") == "rolling_sum_features.deposits_sum_2h"
    assert names.canonical_name("plain") == "plain"
    with pytest.raises(ValueError):
        names.canonical_name("view__")
    mapping = names.business_names()
    assert len(mapping) == 145 and len(set(mapping.values())) == len(mapping) - 0
    assert mapping["deposits_from_counter_party_features.deposits_from_cp_max_60d"] == "rolling_max_of_deposits_from_counter_party_60d"
    assert mapping["withdrawals_to_counter_party_features.withdrawals_sum_60days"] == "rolling_sum_of_withdrawals_to_counter_party_60d"


def test_validation_rules(spark):
    df = spark.createDataFrame([(1, 0, 1.0, "a"), (2, 5, 90.5, None), (1, 1, 91.0, "b")], "f int, event int, duration double, t string")
    rep = {r["rule"]: r["violations"] for r in validate.validation_report(df, ["f", "t", "gone"], [], ["f", "t"], "event", "duration").collect()}
    assert rep == {"missing_columns": 1, "feature_type": 1, "label_type": 0, "unexpected_nulls": 1, "event_not_binary": 1,
                   "duration_not_integral": 1, "duration_out_of_range": 2}
    with pytest.raises(ValueError):
        validate.validate_dataset(df, ["f"], [], [], "event", "duration")


def test_asof_keeps_null_values(spark):
    s = spark.createDataFrame([("a", datetime(2020, 1, 2))], "k string, ts timestamp")
    f = spark.createDataFrame([("a", datetime(2020, 1, 1), 1.0), ("a", datetime(2020, 1, 2), None)], "k string, fts timestamp, v double")
    assert one(asof.asof_join(s, f, "k", "ts", "fts", ["v"]))["v"] is None
    assert one(asof.asof_join(s, f, "k", "ts", "fts", ["v"], inclusive=False))["v"] == 1.0
