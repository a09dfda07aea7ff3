"""Writers and dataset paths."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dataset_name(start_year: int, start_month: int, end_year: int, end_month: int, stem: str) -> str:
    """Canonical name of a dataset period, such as ``risk_06_2018_12_2020`` for the stem ``risk``."""
    return f"{stem}_{start_month:02d}_{start_year}_{end_month:02d}_{end_year}"


def write_dataset(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None, spread: int = 8) -> None:
    """Parquet write; fails when the path exists unless ``overwrite``.

    Partitioned writes are clustered first: each partition value gets at most ``spread`` files,
    its rows dealt out by a hash of the row, rather than one file from every task.
    """
    if partition_by:
        df = df.repartition(*partition_by, F.pmod(F.xxhash64(*df.columns), F.lit(spread)))
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Gzip CSV with a header, one file per partition (arrays must be flattened first)."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option(
        "compression", "gzip").csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a parquet dataset can be opened at ``path``."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def build_once(spark: SparkSession, path: str, build) -> DataFrame:
    """Return the dataset at ``path``, building it with ``build()`` only when it is missing."""
    if not exists(spark, path):
        write_dataset(build(), path)
    return spark.read.parquet(path)
