"""Fit / transform pipelines with a fixed list of output columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import encode


@dataclass
class FeaturePipeline:
    """Fitted stages applied in order, then a fixed projection.

    ``keep`` names identifying columns carried along where present (a label, for example, is
    absent when new rows are scored).
    """

    stages: list
    keep: list[str]
    outputs: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage.transform(df)
        return df.select(*[c for c in self.keep if c in df.columns], *self.outputs)

    def feature_names(self) -> list[str]:
        return list(self.outputs)


# Fixed values: (tolerance, number of categories) of the member categories.
RARE = {
    "company_type": (0.0005, 10), "applicant_id_type": (0.1, 5), "applicant_id_country_issue": (0.01, 5),
    "applicant_postcode": (0.02, 5), "section_description": (0.03, 5),
}


def fit_features(df: DataFrame, zero_filled: list[str], scaled: list[str], categories: dict[str, tuple[float, int]],
                 passed: list[str], keep: list[str]) -> FeaturePipeline:
    """Fill and scale numbers, group rare categories and one-hot them, pass the rest through.

    ``zero_filled`` columns are filled with 0 before scaling; ``scaled`` only scaled.
    Categories are filled with ``missing``.
    """
    constants = {**{c: 0.0 for c in zero_filled}, **{c: "missing" for c in categories}}
    stages: list = [encode.fit_imputer(df, constants)]
    x = stages[0].transform(df)
    numbers = [*zero_filled, *scaled]
    scaler = encode.fit_standard_scaler(x, numbers)
    names = list(numbers)
    encoders: list = []
    for column, (tol, n) in categories.items():
        rare = encode.fit_rare(x, column, tol, n)
        hot = encode.fit_one_hot(rare.transform(x), column)
        encoders += [rare, hot]
        names += hot.names
    return FeaturePipeline([*stages, scaler, *encoders], keep, [*names, *passed])


