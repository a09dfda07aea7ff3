"""Reports on members: labelled dataset, training and monthly evaluation as single lazy plans."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import month_key
from ..operators import (
    asof, calendar, labels, model, payment, pipeline, prefix, profile, select, spine, splits, validate,
)


def labelled_dataset(members: DataFrame, reports: DataFrame, start: date, stop: date, mode: str = "random",
                     features: DataFrame | None = None, feature_ts: str = "feature_ts", columns: list[str] | None = None,
                     days: int = labels.REPORT_DAYS, seed: int = 0, earliest: date = calendar.EARLIEST_START) -> DataFrame:
    """calendar -> spine -> point-in-time features -> first report in the window -> targets.

    ``members``: company_id, is_approved, approved_at, is_rejected, rejected_at and optionally
    incorporated_at. ``reports``: company_id, reported_at.
    """
    calendar.check_period(start, stop, earliest)
    dates = calendar.feature_dates(members.sparkSession, start, stop, mode, seed=seed)
    carry = ["incorporated_at"] if "incorporated_at" in members.columns else []
    rows = spine.member_spine(dates, members, carry)
    dated = labels.first_report_after(rows, reports, days)
    if features is not None:
        dated = asof.asof_join(dated, features, "company_id", "timestamp", feature_ts, columns or [])
    out = labels.event_targets(dated.withColumn("duration", labels.whole_days("first_report_at", "timestamp")), days=days)
    if carry:
        out = out.withColumn("days_since_incorp", labels.days_since_incorporation("incorporated_at", "first_report_at", "timestamp", days))
        out = out.withColumn("days_since_incorp_at_ts", F.datediff("timestamp", "incorporated_at"))
    return out


# Model columns of the report model.
MEMBER_COLUMNS = ("days_since_incorp", "is_registered", "company_type", "mkyc_ind", "age_at_completion")
CATEGORY_COLUMNS = ("applicant_id_type", "applicant_id_country_issue", "applicant_postcode", "section_description")
TRANSACTION_COLUMNS = (
    "avg_deposit", "avg_withdrawal", "max_deposit", "max_withdrawal", "pct_round_txns", "pct_unique_txns", "tester_pmt_cnt",
    "cashtxns_latehrs", "cardpmt_wtd_pct", "fastpmt_wtd_pct", "ddebit_wtd_pct", "cardwtd_wtd_pct", "outpmt_wtd_pct",
    "fastpmt_dep_pct", "cash_dep_pct", "inpmt_dep_pct", "fastpmt_beneficiaries", "fastpmt_benefactors", "cardpmt_acceptors",
    "ddebit_beneficiaries", "deposit_wtd_frequency_ratio", "hmrc_txns_cnt", "xero_txns_cnt", "pos_atm_locations",
    "card_pans_cnt", "high_card_pmts", "high_card_wtds", "high_fpmt_out", "high_pmt_out", "high_ddebit", "high_fpmt_in",
    "max_cash_deposits", "high_pmt_in",
)
MANDATORY_COLUMNS = ("is_registered", "mkyc_ind", "event", "duration", "age_at_completion")


def member_categories(df: DataFrame) -> DataFrame:
    """Canonical spelling of the member categories and the area of the postcode."""
    country = F.col("applicant_id_country_issue")
    return df.withColumns({
        "applicant_postcode": prefix.area_code("applicant_postcode"),
        "applicant_id_type": payment.tidy_text("applicant_id_type", {"driving_license": "driving_licence"}),
        "company_type": payment.tidy_text("company_type", {"private-limited-guarant-nsc": "private_limited_guarant_nsc"}),
        "applicant_id_country_issue": F.when(country == "GB", "GBR").otherwise(country)})


def fit_member_features(df: DataFrame, keep: list[str]) -> pipeline.FeaturePipeline:
    """The feature pipeline of the model on a table with the columns listed above."""
    return pipeline.fit_features(member_categories(df), ["days_since_incorp", *TRANSACTION_COLUMNS], ["age_at_completion"],
                                 pipeline.RARE, ["is_registered", "mkyc_ind"], keep)


class RiskModel:
    """Fitted features, selected columns and a calibrated probability of a report."""

    def __init__(self, features: pipeline.FeaturePipeline, columns: list[str], classifier, slope: float, intercept: float):
        self.features, self.columns, self.classifier = features, columns, classifier
        self.slope, self.intercept = slope, intercept

    def predict(self, df: DataFrame, low: float = 0.005, high: float = 0.01) -> DataFrame:
        x = self.features.transform(df)
        p = model.score_logistic(self.classifier, x, self.columns, "raw")
        calibrated = p.withColumn("survival", 1 - model.apply_platt("raw", self.slope, self.intercept))
        return model.rate_predictions(calibrated.select(*[c for c in self.features.keep if c != "event"], "survival"), low=low, high=high)


def train(dataset: DataFrame, id_col: str, zero_filled: list[str], scaled: list[str], categories: dict[str, tuple[float, int]],
          mandatory: list[str], test_share: float = 0.2, seed: int = 0) -> RiskModel:
    """Preprocess, validate, split 80/20 by class, fit features, select, fit, calibrate on the held-out part.

    ``id_col`` must be unique: the split ranks rows by its hash.
    """
    clean = validate.preprocess_dataset(dataset, "duration", mandatory)
    validate.validate_dataset(clean, [*mandatory, "event", "duration"], [], [*scaled], "event", "duration")
    parts = splits.stratified_split(clean, ["event"], id_col, test_share, seed)
    fit_part, held = parts.where("split = 'train'"), parts.where("split = 'test'")
    keep = [id_col, "company_id", "timestamp", "event"]
    f = pipeline.fit_features(fit_part, zero_filled, scaled, categories, [], keep)
    x = f.transform(fit_part)
    columns = select.select_features(x, f.feature_names())
    classifier = model.fit_logistic(x, columns, "event")
    scored = model.score_logistic(classifier, f.transform(held), columns, "raw")
    return RiskModel(f, columns, classifier, *model.fit_platt(scored, "raw", "event"))


def monthly_trend(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Share and event rate per risk level and month, with Average and Std rows: one aggregation
    instead of a loop over months. Joined on (company_id, timestamp)."""
    joined = predictions.join(outcomes.select("company_id", "timestamp", "event"), ["company_id", "timestamp"])
    return profile.risk_trend(joined.withColumn("month_year", month_key("timestamp")), "month_year", "risk_rating", "event")
