"""The end-to-end plans on hand-made companies."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskframe.plans import new_company, report_risk, payment_scoring


@pytest.fixture(scope="module")
def world(spark):
    n = 120
    start = date(2020, 1, 1)
    members = spark.createDataFrame(
        [(str(i), 1, start - timedelta(days=20 + i % 40), int(i % 10 == 0), start + timedelta(days=200) if i % 10 == 0 else None, start - timedelta(days=400 + i))
         for i in range(n)], "company_id string, is_approved int, approved_at date, is_rejected int, rejected_at date, incorporated_at date")
    reports = spark.createDataFrame([(str(i), start + timedelta(days=(i * 13) % 330)) for i in range(n) if i % 3 == 0], "company_id string, reported_at date")
    feats = spark.createDataFrame([(str(i), datetime(2019, 12, 1) + timedelta(days=30 * k), float(i % 3 == 0) * 2 + (i * 7 + k) % 5, "LTD" if i % 2 else "SOLE")
                                   for i in range(n) for k in range(10)], "company_id string, feature_ts timestamp, score double, kind string")
    return members, reports, feats


def test_report_risk_from_dataset_to_trend(spark, world):
    members, reports, feats = world
    ds = report_risk.labelled_dataset(members, reports, date(2020, 1, 1), date(2020, 9, 30), "first", feats, columns=["score", "kind"])
    assert {"event", "duration", "score", "kind", "days_since_incorp"} <= set(ds.columns)
    assert ds.where("feature_ts > timestamp").isEmpty()
    rows = ds.withColumn("row_id", F.concat_ws("-", "company_id", "timestamp"))
    m = report_risk.train(rows, "row_id", ["days_since_incorp"], ["score"], {"kind": (0.01, 5)}, ["score"])
    p = m.predict(rows, 0.05, 0.2)
    assert p.count() == rows.count() and p.where("survival < 0 or survival > 1").isEmpty()
    t = report_risk.monthly_trend(p, rows)
    assert {"Average", "Std"} <= {r["month_year"] for r in t.collect()}


def test_new_company_labels_and_study(spark, world):
    members, _, _ = world
    base = datetime(2020, 1, 1)
    tx = spark.createDataFrame([(str(i), 5.0, "Payment", date(2020, 1, 1) + timedelta(days=i % 50), 1) for i in range(120)],
                               "company_id string, amount double, transactiontype string, transactiondate date, fullycleared int")
    fr = spark.createDataFrame([(str(i), base + timedelta(days=10 + i % 60), "Mule", float(i)) for i in range(0, 120, 4)],
                               "company_id string, transaction_at timestamp, app_fraud_type string, amount double")
    a = new_company.labelled_spine(members, tx, fr, date(2020, 1, 1), date(2020, 3, 31), 120, "first")
    b = new_company.labelled_spine(members, tx, fr, date(2020, 1, 1), date(2020, 3, 31), 120, "first", arrays=True)
    key = lambda d: sorted(tuple(r) for r in d.select("company_id", "timestamp", "is_app_fraud_45d", "days_to_fraud_45d", "app_fraud_amount_45d").collect())
    assert [tuple(map(str, r)) for r in key(a)] == [tuple(map(str, r)) for r in key(b)]
    s = new_company.training_and_scoring(a, date(2020, 1, 1), date(2020, 2, 15))
    assert {r["split"] for r in s.select("split").distinct().collect()} == {"training", "scoring"}
    assert new_company.missed_companies(fr, a).count() < 30


def test_payment_features_from_raw_columns(spark):
    raw = spark.createDataFrame(
        [(str(i), 10.0 + i, 1_700_000_000 + i, float(i) if i % 3 else None, None if i % 2 else 1, 0, "Passport" if i % 2 else None, i % 2) for i in range(60)],
        "company_id string, requested_payment_value double, timestamp long, rolling_sum_features_v3__deposits_sum_2h_continuous double, "
        "ifre_member_features_v2__is_registered int, company_core_features_v3__is_registered int, ifre_member_features_v2__applicant_id_type string, target int")
    x = payment_scoring.business_table(raw)
    assert {"rolling_sum_of_deposits_on_account_2h", "is_registered_company", "member_id_type", "rule_feature_request_timestamp"} <= set(x.columns)
    assert x.where("is_registered_company is null").isEmpty()
    m = payment_scoring.fit_payment_features(x, "target")
    out = m.transform(x, explain=True)
    assert dict(out.dtypes)["member_id_type"] == "double" and out.where("member_id_type is null").isEmpty()
    assert out.where("net_balance_indicator is null or model_explainability_features is null").isEmpty()
    cols = payment_scoring.model_columns()
    assert len(cols) == len(set(cols)) and set(payment_scoring.model_columns(False)) < set(cols)


def test_onboarding_features(spark):
    directors = '[{"firstname":"Ann","lastname":"Lee","dob":"1980-01-01","nationality":"IRL"},{"firstname":"Bo","lastname":"Ek","dob":"1970-01-01","nationality":"SWE"}]'
    raw = spark.createDataFrame([("1", " ann ", "LEE", "1980-01-01", "UNKNOWN", directors, "62012,7", "SW1A 1AA", "EC1", '{"1": 4}', "x1@gmail.com", "2020-01-01",
                                  "2020-01-05", " IOS ", " Retail ", "2025-01-01", None, "Best Bank", "a,b", None, "Passport", "full", "IE")],
        "company_id string, applicant_id_firstname_rawdata string, applicant_id_lastname_rawdata string, applicant_dob_rawdata string, applicant_nationality_rawdata string, "
        "directorstree string, company_sic_rawdata string, company_postcode_rawdata string, applicant_postcode_rawdata string, structurelevelwise string, applicant_email_rawdata string, "
        "created_on string, approved_at string, applicant_device_type_rawdata string, company_icc_rawdata string, applicant_id_expiry_rawdata string, company_type_rawdata string, "
        "company_trading_name_rawdata string, manual_approval_triggers_rawdata string, company_is_registered_rawdata int, applicant_id_type_rawdata string, applicant_id_subtype_rawdata string, "
        "applicant_idcountry_issue_rawdata string")
    countries = spark.createDataFrame([("IRL", "IE"), ("IE", "IE")], "any_code string, code string")
    kinds = spark.createDataFrame([("passport", "FULL", "ie", "passport-ie")], "id_type string, id_subtype string, id_country string, id_value string")
    r = new_company.onboarding_features(raw, countries, kinds, ["bank"]).collect()[0]
    want = {"applicant_nationality_0": "IE", "applicant_nationality_1": None, "company_sic_0": "62012", "company_sic_1": "00007", "company_sic_2": None, "company_postcode": "SWA",
            "applicant_postcode": "EC", "company_structurelevelwise_1": "3+", "company_directors_count": "2", "applicant_email_numeric": 1, "applicant_email_domain": "gmail.com",
            "days_to_approval": 4, "applicant_device_type": "ios", "company_type": "SOLE-TRADER", "is_restricted_keyword_present": 1, "company_is_registered": 0,
            "applicant_id_type": "passport-ie", "applicant_idcountry_issue": "IE"}
    assert {k: r[k] for k in want} == want
    assert 39 < r["applicant_age_at_completion"] < 41 and 4.9 < r["applicant_years_to_id_expiry"] < 5.1


def test_member_features(spark):
    cols = {**{c: 1.0 for c in report_risk.TRANSACTION_COLUMNS}, "days_since_incorp": 5.0, "age_at_completion": 30.0, "is_registered": 1.0, "mkyc_ind": 0.0}
    texts = {"company_type": "LTD", "applicant_id_type": "Driving_License", "applicant_id_country_issue": "GB", "applicant_postcode": "SW1A", "section_description": "x"}
    df = spark.createDataFrame([(str(i), *cols.values(), *texts.values()) for i in range(5)],
                               "company_id string, " + ", ".join(f"{c} double" for c in cols) + ", " + ", ".join(f"{c} string" for c in texts))
    p = report_risk.fit_member_features(df, ["company_id"])
    out = p.transform(report_risk.member_categories(df))
    assert "applicant_id_country_issue_GBR" in out.columns and "applicant_postcode_SW" in out.columns and "applicant_id_type_driving_licence" in out.columns
