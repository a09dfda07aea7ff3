"""New-company fraud: tenure spine with multi-horizon labels, splits, weights and label study."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import calendar, curves, labels, spine, validate, weights


def labelled_spine(members: DataFrame, transactions: DataFrame, frauds: DataFrame, start: date, stop: date,
                   tenure_days: int, mode: str = "random", seed: int = 0, arrays: bool = False) -> DataFrame:
    """Members in their tenure period at each date with 30/45/60/90-day fraud labels.

    ``arrays`` also keeps the sorted label array; the default never builds it.
    """
    dates = calendar.feature_dates(members.sparkSession, start, stop, mode, seed=seed)
    rows = spine.tenure_spine(dates, members, transactions, tenure_days)
    hits = labels.spine_frauds(rows, labels.fraud_list(frauds, start, stop), tenure_days)
    if arrays:
        with_array = labels.array_labels(rows, hits)
        return with_array.select("*", *labels.horizon_columns())
    return labels.horizon_labels(rows, hits)


def training_and_scoring(dataset: DataFrame, train_from: date, train_to: date) -> DataFrame:
    """Add the ``split`` column (training inside the period, scoring outside) and frequency weights."""
    split = validate.split_periods("timestamp", {"training": (train_from, train_to)}, "scoring")
    return weights.frequency_weights(dataset.withColumn("split", split), "company_id")


def capture_study(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Capture curve of days to fraud and its knee: the horizon beyond which little is gained."""
    curve = curves.capture_curve(hits, "days")
    return curve, curves.knee_point(curve, "days", "share")


def missed_companies(frauds: DataFrame, dataset: DataFrame, flag: str = "is_app_fraud_45d") -> DataFrame:
    """Known fraud companies the dataset does not capture."""
    captured = dataset.where(F.col(flag) == 1).select("company_id")
    return frauds.select("company_id").distinct().join(captured, "company_id", "left_anti")


# Widths of the numbered columns, and the activity dates turned into flags.
NATIONALITIES, INDUSTRY_CODES = 3, 4
ACTIVITY = {
    "receipt_uploaded_before_timestamp": "first_receipt_uploaded_at", "receipt_match_before_timestamp": "first_receipt_match_at",
    "first_invoice_before_timestamp": "date_of_first_invoice", "invoice_matched_before_timestamp": "first_invoice_matched_at",
    "invoice_chased_before_timestamp": "first_invoice_chased_at", "activity_before_timestamp": "last_activity_at",
    "login_before_timestamp": "last_login_at",
}


def ongoing_columns(ts: str = "timestamp") -> dict[str, Column]:
    """Company age, marketing attribution and "happened before the date" flags."""
    return {
        "company_age_at_timestamp": sc.months_between_dates(ts, "incorporation_at"),
        "attribution_marketing_campaign": sc.clean_lower("last_touch_attribution_marketing_campaign_signup", "Unattributed"),
        "attribution_marketing_channel": sc.clean_lower("last_touch_attribution_marketing_channel_signup", "Unattributed"),
        **{name: sc.happened_before(source, ts) for name, source in ACTIVITY.items()},
    }


def onboarding_features(raw: DataFrame, countries: DataFrame, id_types: DataFrame, keywords: list[str],
                        created: str = "created_on") -> DataFrame:
    """Onboarding features from raw application columns.

    ``countries``: (any_code, code), every accepted spelling to the country code. ``id_types``:
    (id_type, id_subtype, id_country, id_value). Both are looked up by planned joins.
    """
    r = lambda n: f"{n}_rawdata"
    people = F.from_json(F.col("directorstree"), sc.DIRECTORS)
    nationalities = sc.known_values([
        sc.director_nationalities("directorstree", r("applicant_id_firstname"), r("applicant_id_lastname"), r("applicant_dob")),
        F.array(F.col(r("applicant_nationality")))])
    sic = sc.industry_codes(r("company_sic"))
    x = raw.select(
        "*",
        *sc.numbered(nationalities, "__nat", NATIONALITIES), *sc.numbered(sic, "company_sic", INDUSTRY_CODES),
        sc.outward_letters(r("company_postcode")).alias("company_postcode"),
        sc.outward_letters(r("applicant_postcode")).alias("applicant_postcode"),
        sc.json_level_bucket("structurelevelwise").alias("company_structurelevelwise_1"),
        sc.count_bucket(F.size(people)).alias("company_directors_count"),
        sc.has_digit(r("applicant_email")).alias("applicant_email_numeric"),
        sc.mail_domain(F.coalesce(F.col(r("applicant_email")), F.lit("nan"))).alias("applicant_email_domain"),
        sc.guarded_age(created, r("applicant_dob")).alias("applicant_age_at_completion"),
        F.datediff(F.col("approved_at").cast("date"), F.col(created).cast("date")).alias("days_to_approval"),
        sc.clean_lower(r("applicant_device_type")).alias("applicant_device_type"), sc.clean_lower(r("company_icc")).alias("company_icc"),
        sc.guarded_expiry(r("applicant_id_expiry"), created).alias("applicant_years_to_id_expiry"),
        sc.company_type_bucket(r("company_type")).alias("company_type"),
        sc.has_keyword(sc.clean_lower(r("company_trading_name")), keywords).alias("is_restricted_keyword_present"),
        sc.split_list(r("manual_approval_triggers")).alias("manual_approval_triggers"),
        F.coalesce(r("company_is_registered"), F.lit(0)).alias("company_is_registered"),
        F.col(r("applicant_id_type")).alias("id_type"), F.col(r("applicant_id_subtype")).alias("id_subtype"),
        F.col(r("applicant_idcountry_issue")).alias("id_country"))
    for i in range(NATIONALITIES):
        x = sc.with_dimension(x, f"__nat_{i}", countries, "any_code", "code", f"applicant_nationality_{i}")
    x = sc.with_dimension(x, "id_country", countries, "any_code", "code", "applicant_idcountry_issue")
    x = sc.with_mapped_type(x, ["id_type", "id_subtype", "id_country"], id_types, "id_value", "applicant_id_type")
    raws = [c for c in x.columns if c.endswith("_rawdata") or c.startswith("__nat_")]
    return x.drop(*raws, "directorstree", "structurelevelwise", "id_type", "id_subtype", "id_country")
