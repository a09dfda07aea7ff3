"""Dataset preparation and the validation rules of a training table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_TYPES = ("int", "bigint", "double")


def preprocess_dataset(df: DataFrame, duration: str, mandatory: list[str]) -> DataFrame:
    """Rows with a positive duration and no null in the mandatory columns."""
    return df.where(F.col(duration) > 0).dropna(subset=mandatory)


def split_periods(ts: Column | str, periods: dict[str, tuple], other: str | None = None) -> Column:
    """Name of the inclusive period a date falls in; ``other`` (also for null dates) if none."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.coalesce(*[F.when(c.between(F.lit(a), F.lit(b)), F.lit(n)) for n, (a, b) in periods.items()], F.lit(other))


def validation_report(df: DataFrame, required: list[str], nullable: list[str], numeric: list[str],
                      event: str, duration: str, horizon: int = 90) -> DataFrame:
    """The seven rules as (rule, violations); one pass over the data."""
    spark = df.sparkSession
    types = dict(df.dtypes)
    have = set(df.columns)
    checked = [c for c in required if c in have and c not in nullable]
    e, d = F.col(event), F.col(duration)
    data_rules = {
        "unexpected_nulls": reduce(lambda a, b: a | b, [F.col(c).isNull() for c in checked], F.lit(False)),
        "event_not_binary": ~F.coalesce(e.isin(0, 1), F.lit(False)),
        "duration_not_integral": ~F.coalesce(d == F.floor(d), F.lit(False)),
        "duration_out_of_range": ~F.coalesce(d.between(1, horizon), F.lit(False)),
    }
    schema_rules = {
        "missing_columns": len([c for c in required if c not in have]),
        "feature_type": len([c for c in numeric if types.get(c) not in NUMERIC_TYPES]),
        "label_type": len([c for c in (event, duration) if types.get(c) not in NUMERIC_TYPES]),
    }
    counted = df.agg(*[F.count_if(cond).alias(n) for n, cond in data_rules.items()])
    for name, n in schema_rules.items():
        counted = counted.withColumn(name, F.lit(n).cast("long"))
    names = list(schema_rules) + list(data_rules)
    return counted.unpivot([], names, "rule", "violations")


def validate_dataset(df: DataFrame, *args, **kwargs) -> DataFrame:
    """Return ``df`` or raise with the broken rules."""
    broken = {r["rule"]: r["violations"] for r in validation_report(df, *args, **kwargs).where("violations > 0").collect()}
    if broken:
        raise ValueError(f"dataset breaks the rules {broken}")
    return df


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, null_rate) of every column in one pass."""
    cols = columns or df.columns
    return df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols]).unpivot([], cols, "column", "null_rate")
