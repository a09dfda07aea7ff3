"""Feature selection: variance and collinearity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Smallest variance and largest variance inflation.
MIN_VARIANCE, MAX_VIF = 0.1, 10.0


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population variance of every column in one aggregation: (column, variance)."""
    return df.agg(*[F.var_pop(c).alias(c) for c in columns]).unpivot([], columns, "column", "variance")


def varying_columns(df: DataFrame, columns: list[str], threshold: float = MIN_VARIANCE) -> list[str]:
    kept = {r["column"] for r in variances(df, columns).where(F.col("variance") > threshold).collect()}
    return [c for c in columns if c in kept]


def _gram(columns: list[str], shift: np.ndarray):
    """Per task and column: over the rows in which both columns are known, for every other column, their number and the sums of values, squares and products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(columns)
        total = np.zeros((4, p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0), known.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pa.RecordBatch.from_pydict({"i": np.arange(p, dtype=np.int32), **{n: list(t) for n, t in zip("nsqp", total)}})

    return run


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson matrix over the rows in which both columns of a pair are known, in one pass.

    Nulls and NaN count as missing. Tasks send p x p partial sums, added up before p x p numbers reach the driver.
    A pair without two known rows or without spread has correlation 0.
    """
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    # any values near the data keep the sums of squares small
    near = rows.limit(1000).agg(*[F.avg(F.nanvl(c, F.lit(None))).alias(c) for c in rows.columns]).first()
    shift = np.array([v if v is not None else 0.0 for v in near])
    parts = rows.mapInArrow(_gram(columns, shift), "i int, n array<double>, s array<double>, q array<double>, p array<double>")
    cells = parts.select("i", F.posexplode(F.arrays_zip("n", "s", "q", "p")).alias("j", "z")).groupBy("i", "j").agg(*[F.sum(f"z.{c}").alias(c) for c in "nsqp"])
    size = len(columns)
    n, s, q, p = (np.zeros((size, size)) for _ in range(4))
    for r in cells.collect():
        n[r["i"], r["j"]], s[r["i"], r["j"]], q[r["i"], r["j"]], p[r["i"], r["j"]] = r["n"], r["s"], r["q"], r["p"]
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = q - s * s / n
        out = (p - s * s.T / n) / np.sqrt(spread * spread.T)
    out[~np.isfinite(out)] = 0
    np.fill_diagonal(out, 1)
    return out


def inflation(matrix: np.ndarray) -> np.ndarray:
    """Variance inflation factors: the diagonal of the (pseudo-)inverse correlation."""
    try:
        return np.linalg.inv(matrix).diagonal()
    except np.linalg.LinAlgError:
        return np.linalg.pinv(matrix).diagonal()


def vif_table(df: DataFrame, columns: list[str]) -> DataFrame:
    vifs = np.linalg.pinv(correlation_matrix(df, columns)).diagonal()
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, vifs)], "column string, vif double")


def uncorrelated_columns(df: DataFrame, columns: list[str], threshold: float = MAX_VIF) -> list[str]:
    """Drop the column of largest inflation until all are below the threshold.

    The data is read once; every round works on a sub-matrix of the one correlation matrix.
    """
    matrix, kept = correlation_matrix(df, columns), list(range(len(columns)))
    while len(kept) > 1:
        vifs = inflation(matrix[np.ix_(kept, kept)])
        worst = int(np.argmax(vifs))
        if vifs[worst] < threshold:
            break
        kept.pop(worst)
    return [columns[i] for i in kept]


def selection(df: DataFrame, columns: list[str], min_variance: float = MIN_VARIANCE, max_vif: float = MAX_VIF) -> DataFrame:
    """Both filters as rows (column, kept)."""
    kept = set(select_features(df, columns, min_variance, max_vif))
    return df.sparkSession.createDataFrame([(c, c in kept) for c in columns], "column string, kept boolean")


def select_features(df: DataFrame, columns: list[str], min_variance: float = MIN_VARIANCE, max_vif: float = MAX_VIF) -> list[str]:
    """Variance filter, then the collinearity filter."""
    return uncorrelated_columns(df, varying_columns(df, columns, min_variance), max_vif)
