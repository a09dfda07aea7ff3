"""Models: elastic-net logistic regression, Platt calibration, survival, batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, AFTSurvivalRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import risk_level


def assemble(df: DataFrame, features: list[str], out: str = "__features") -> DataFrame:
    """Feature vectors for a fit; a null or NaN feature raises, so no row is left out unseen."""
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(df)


def complete(features: list[str]) -> Column:
    """Whether a row has all features."""
    ok = F.lit(True)
    for f in features:
        ok = ok & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return ok


def _for_scoring(df: DataFrame, features: list[str]) -> DataFrame:
    """All rows with vectors and ``__complete``; missing features stand as 0 and their score is nulled."""
    filled = df.withColumn("__complete", complete(features))
    named = [f"__f{i}" for i in range(len(features))]
    filled = filled.withColumns({n: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for n, f in zip(named, features)})
    return VectorAssembler(inputCols=named, outputCol="__features").transform(filled)


def fit_logistic(df: DataFrame, features: list[str], label: str, weight: str | None = None, c: float = 1.0,
                 l1_ratio: float = 0.5, balanced: bool = True, max_iter: int = 50) -> LogisticRegressionModel:
    """Weighted elastic-net logistic regression; ``regParam`` is 1 / (C * total weight)."""
    w = F.col(weight) if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    s = df.agg(F.sum(w).alias("t"), F.sum(w * y).alias("p")).first()
    total, pos = float(s["t"]), float(s["p"])
    if balanced and 0 < pos < total:
        w = w * F.when(y == 1, total / (2 * pos)).otherwise(total / (2 * (total - pos)))
    rows = assemble(df, features).select("__features", y.alias("__label"), w.cast("double").alias("__weight"))
    lr = LogisticRegression(featuresCol="__features", labelCol="__label", weightCol="__weight", elasticNetParam=l1_ratio,
                            regParam=1.0 / (c * total), maxIter=max_iter, standardization=False)
    return lr.fit(rows)


def importance(model: LogisticRegressionModel, features: list[str], df: DataFrame) -> DataFrame:
    """(feature, coefficient) table."""
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, model.coefficients)], "feature string, coefficient double")


def score_logistic(model: LogisticRegressionModel, df: DataFrame, features: list[str], out: str = "probability") -> DataFrame:
    """Every row with its probability, null where a feature is missing."""
    scored = model.setProbabilityCol("__probability").setRawPredictionCol("__raw").setPredictionCol("__prediction").transform(_for_scoring(df, features))
    p = F.get(vector_to_array(F.col("__probability")), F.lit(1))
    return scored.select(*df.columns, F.when(F.col("__complete"), p).alias(out))


def logistic_expression(coefficients: dict[str, float], intercept: float) -> Column:
    """Probability of a fitted model as a column, for streams and for other engines' coefficients."""
    z = sum((F.col(n) * F.lit(v) for n, v in coefficients.items()), F.lit(intercept))
    return 1 / (1 + F.exp(-z))


def fit_platt(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    """Slope and intercept of the sigmoid calibration of a score on held-out rows."""
    m = fit_logistic(df, [score], label, balanced=False, c=1e6, l1_ratio=0.0, max_iter=100)
    return float(m.coefficients[0]), float(m.intercept)


def apply_platt(score: str, slope: float, intercept: float) -> Column:
    return logistic_expression({score: slope}, intercept)


def kaplan_meier(df: DataFrame, duration: str, event: str, keys: list[str] | None = None) -> DataFrame:
    """Survival curve per segment: at risk, events and survival at each duration.

    Counted per duration first (whole periods of a bounded horizon), so the ordered part
    sees one row per period.
    """
    keys = keys or []
    per = df.groupBy(*keys, F.col(duration).alias("duration")).agg(
        F.count(F.lit(1)).alias("leaving"), F.sum(F.col(event).cast("long")).alias("events"))
    part = W.partitionBy(*(keys or [F.lit(0)])).orderBy("duration")
    ahead = F.sum("leaving").over(part.rowsBetween(0, W.unboundedFollowing))
    k = per.select(*keys, "duration", "leaving", "events", ahead.alias("at_risk"))
    alive = F.col("at_risk") - F.col("events")
    upto = part.rowsBetween(W.unboundedPreceding, 0)
    died_out = F.max((alive == 0).cast("int")).over(upto)
    log_s = F.sum(F.when(alive > 0, F.ln(alive / F.col("at_risk")))).over(upto)
    return k.select(*keys, "duration", "at_risk", "events",
                    F.when(died_out == 1, F.lit(0.0)).otherwise(F.exp(F.coalesce(log_s, F.lit(0.0)))).alias("survival"))


def survival_at(curve: DataFrame, horizon: int, keys: list[str] | None = None) -> DataFrame:
    """Survival probability at a horizon per segment."""
    keys = keys or []
    return curve.groupBy(*keys).agg(F.coalesce(F.max_by(F.when(F.col("duration") <= horizon, F.col("survival")),
                                                       F.when(F.col("duration") <= horizon, F.col("duration"))), F.lit(1.0)).alias("survival"))


def fit_survival_regression(df: DataFrame, features: list[str], duration: str, event: str) -> AFTSurvivalRegressionModel:
    """Accelerated-failure-time model with covariates (durations must be positive)."""
    rows = assemble(df, features).select("__features", F.col(duration).cast("double").alias("__t"), F.col(event).cast("double").alias("__e"))
    return AFTSurvivalRegression(featuresCol="__features", labelCol="__t", censorCol="__e").fit(rows)


def survival_probability(model: AFTSurvivalRegressionModel, df: DataFrame, features: list[str], horizon: float, out: str = "survival") -> DataFrame:
    """Weibull survival at the horizon: exp(-(t / lambda)^(1 / scale)); null where a feature is missing."""
    p = model.setPredictionCol("__lambda").transform(_for_scoring(df, features))
    s = F.exp(-F.pow(F.lit(horizon) / F.col("__lambda"), F.lit(1.0 / model.scale)))
    return p.select(*df.columns, F.when(F.col("__complete"), s).alias(out))


def rate_predictions(df: DataFrame, survival: str = "survival", low: float = 0.005, high: float = 0.01, out: str = "risk_rating") -> DataFrame:
    return df.withColumn(out, risk_level(survival, low, high))


def score_with(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], features: list[str], keep: list[str],
               out: str = "probability") -> DataFrame:
    """Score with any Python model: ``predict`` gets Arrow batches of the feature columns.

    The function is shipped once per task; only ``keep`` and ``features`` are sent to Python.
    """
    narrow = df.select(*keep, *[f for f in features if f not in keep])
    schema = ", ".join(f"`{n}` {k}" for n, k in narrow.select(*keep).dtypes) + f", `{out}` double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result = batch[keep].copy()
            result[out] = predict(batch[features]).to_numpy(dtype=float)
            yield result

    return narrow.mapInPandas(run, schema)
