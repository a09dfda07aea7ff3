"""Readers: warehouse queries, parquet, CSV and time-bounded feature sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_query(spark: SparkSession, text: str, fmt: str | None = None, options: dict[str, str] | None = None,
               views: dict[str, DataFrame] | None = None, args: dict | None = None) -> DataFrame:
    """Run a query at its source.

    With ``fmt`` (for example ``jdbc``) the text is pushed to that source through its
    ``query`` option. Without it the text runs on Spark over ``views``; ``args`` binds named
    parameters (``:name``), so values are never pasted into the text.
    """
    if fmt is not None:
        if args:
            raise ValueError("named parameters need a Spark-side query; bind them in the source's own options")
        return spark.read.format(fmt).options(**(options or {})).option("query", text).load()
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args or {})


def read_table(spark: SparkSession, table: str, options: dict[str, str], partition_column: str, lower, upper, partitions: int,
               fmt: str = "jdbc") -> DataFrame:
    """Read a table or a parenthesised query in ``partitions`` parallel ranges of ``partition_column``.

    The bounds only place the ranges: rows outside them are read by the first and last task.
    ``read_query`` with a source goes through one task and is for small results.
    """
    ranges = {"dbtable": table, "partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}
    return spark.read.format(fmt).options(**(options | ranges)).load()


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True,
             timestamps: dict[str, str] | None = None) -> DataFrame:
    """CSV (plain or gzip) with declared types; ``timestamps`` maps text columns to the
    pattern they are parsed with, bad values becoming null."""
    df = spark.read.schema(schema).option("header", header).csv(path)
    for name, pattern in (timestamps or {}).items():
        df = df.withColumn(name, F.try_to_timestamp(F.col(name), F.lit(pattern)))
    return df


def read_list(spark: SparkSession, path: str, name: str = "area_code") -> DataFrame:
    """Headerless one-column reference list."""
    return spark.read.schema(f"{name} string").csv(path)


def source_for_spine(spine: DataFrame, source: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Left join of a data source on (keys, ts), the source first cut to the spine's time range.

    The two bounds are read first (one job over the spine's time column) and enter the scan as
    literals, so files and row groups outside them are skipped.
    """
    low, high = spine.agg(F.min(ts), F.max(ts)).first()
    inside = source.where(F.col(ts).between(F.lit(low), F.lit(high))) if low is not None else source.limit(0)
    return spine.join(inside, [*keys, ts], "left")


def repair_columns(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Cast text columns, values that do not parse becoming null (NaN too)."""
    out = df
    for name, kind in casts.items():
        c = F.col(name).try_cast(kind)
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        out = out.withColumn(name, c)
    return out
