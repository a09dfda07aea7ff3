"""Repeatable splits, folds, shuffles and down-sampling, all from a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashing import MIX_MODULUS, portable_fraction, portable_mix
from .chunks import CHUNKS, attach_totals, group_sizes, row_numbers


def _ranked(df: DataFrame, strata: list[str], id_col: str, seed: int, n_chunks: int) -> DataFrame:
    mixed = df.withColumn("__mix", portable_mix(id_col, seed))
    ranked = row_numbers(mixed, strata, ["__mix", id_col], "__rn", n_chunks=n_chunks)
    return attach_totals(ranked, strata, group_sizes(df, strata, "__n"))


def stratified_split(df: DataFrame, strata: list[str], id_col: str, test_share: float, seed: int = 0,
                     out: str = "split", n_chunks: int | None = CHUNKS) -> DataFrame:
    """Exactly floor(share * n) rows of each class become ``test``, in hash order."""
    ranked = _ranked(df, strata, id_col, seed, n_chunks)
    is_test = F.col("__rn") <= F.floor(F.col("__n") * F.lit(test_share) + 1e-9)
    return ranked.withColumn(out, F.when(is_test, "test").otherwise("train")).drop("__mix", "__rn", "__n")


def stratified_folds(df: DataFrame, strata: list[str], id_col: str, k: int, seed: int = 0,
                     out: str = "fold", n_chunks: int | None = CHUNKS) -> DataFrame:
    """Fold number 0..k-1, dealt out in hash order inside each class."""
    ranked = _ranked(df, strata, id_col, seed, n_chunks)
    return ranked.withColumn(out, ((F.col("__rn") - 1) % k).cast("int")).drop("__mix", "__rn", "__n")


def repeated_folds(df: DataFrame, strata: list[str], id_col: str, k: int, repeats: int, out: str = "fold", repeat: str = "repeat",
                   n_chunks: int | None = CHUNKS) -> DataFrame:
    """Every row ``repeats`` times, with a fold number of its own each time; rows are ranked once for all repeats.

    The seed is added to the mix, modulo its range: repeat r has the order of repeat 0, but the rows whose mix is among the
    r largest come first. So ranks of all repeats follow from one, and from the count of those rows.
    """
    mixed, wraps = df.withColumn("__mix", portable_mix(id_col)), lambda r: F.col("__mix") >= MIX_MODULUS - r
    totals = mixed.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"), F.array(*[F.count_if(wraps(r)) for r in range(repeats)]).alias("__first"))
    ranked = attach_totals(row_numbers(mixed, strata, ["__mix", id_col], "__rn", n_chunks=n_chunks), strata, totals)
    many = ranked.withColumn(repeat, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    place = F.col("__rn") + F.get("__first", F.col(repeat)) - F.when(wraps(F.col(repeat)), F.col("__n")).otherwise(0)
    return many.withColumn(out, ((place - 1) % k).cast("int")).drop("__mix", "__rn", "__n", "__first")


def out_of_fold_rate(df: DataFrame, group: str, label: str, repeat: str = "repeat", fold: str = "fold", out: str = "risk",
                     weight: str | None = None) -> DataFrame:
    """Add the label's rate among the group's rows of the other folds: a baseline model of every fold, fitted in one aggregation.

    Null where the other folds have no row of the group. ``weight`` is the number of equal rows that a row stands for.
    """
    n = F.col(weight) if weight else F.lit(1)
    per = df.groupBy(repeat, group, fold).agg(F.sum(F.col(label) * n).alias("__y"), F.sum(n).alias("__n"))
    every = W.partitionBy(repeat, group)  # one row for each fold
    rest = lambda c: F.sum(c).over(every) - F.col(c)
    rates = per.select(repeat, group, fold, F.try_divide(rest("__y"), rest("__n")).alias(out))
    return df.join(rates, [repeat, group, fold], "left")


def company_split(df: DataFrame, company: str, label: str, test_share: float = 0.25, seed: int = 0,
                  n_chunks: int | None = CHUNKS) -> DataFrame:
    """Split by company, stratified on its largest label; all rows of a company go together."""
    per = df.groupBy(company).agg(F.max(label).alias("__y"))
    assigned = stratified_split(per, ["__y"], company, test_share, seed, n_chunks=n_chunks)
    return df.join(assigned.select(company, "split"), company)


def downsample(df: DataFrame, label: str, id_col: str, negative_share: float = 0.03, seed: int = 0) -> DataFrame:
    """All positives and a hash-chosen share of the negatives (the sampling is the feature)."""
    return df.where((F.col(label) == 1) | (portable_fraction(id_col, seed) < negative_share))


def shuffle_key(id_col: Column | str, seed: int = 0) -> Column:
    """Sort key of a repeatable shuffle."""
    return portable_mix(id_col, seed)
