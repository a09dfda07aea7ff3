"""Fitted encoders. Fitting gives a model whose state is small data (numbers or a table of
categories); ``transform`` applies it to any later table and never refits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_normal, portable_mix
from .chunks import exact_quantiles, row_numbers
from .profile import weighted_std


def _lit_row(df: DataFrame) -> dict:
    """The single row of an aggregation, as a dict."""
    return df.first().asDict()


# ---- imputation and scaling --------------------------------------------------------------

@dataclass
class Imputer:
    values: dict[str, object]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items() if v is not None})


def fit_imputer(df: DataFrame, constants: dict[str, object] | None = None, medians: list[str] | None = None) -> Imputer:
    """Constants per column, and exact medians learned by distributed ranking."""
    values = dict(constants or {})
    for c in medians or []:
        row = exact_quantiles(df, [], c, [0.5], ["m"]).first()
        values[c] = row["m"] if row else None
    return Imputer(values)


@dataclass
class Scaler:
    """(x - shift) / scale per column."""

    shift: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: (F.col(c) - F.lit(self.shift[c])) / F.lit(self.scale[c]) for c in self.shift})


def fit_standard_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """Mean and population standard deviation; a constant column keeps scale 1."""
    r = _lit_row(df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]))
    return Scaler({c: r[f"m_{c}"] or 0.0 for c in columns}, {c: r[f"s_{c}"] or 1.0 for c in columns})


def fit_min_max_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    r = _lit_row(df.agg(*[F.min(c).alias(f"l_{c}") for c in columns], *[F.max(c).alias(f"h_{c}") for c in columns]))
    lo = {c: float(r[f"l_{c}"] or 0) for c in columns}
    return Scaler(lo, {c: (float(r[f"h_{c}"] or 0) - lo[c]) or 1.0 for c in columns})


# ---- categories ----------------------------------------------------------------------------

@dataclass
class CategoryTable:
    """Category -> number, kept as a DataFrame and joined on.

    The join carries no broadcast hint: its planner broadcasts the table when its measured
    size allows, and shuffles (splitting skewed categories) when it does not.
    """

    table: DataFrame
    column: str
    default: float | None = None

    def transform(self, df: DataFrame, out: str | None = None, column: str | None = None) -> DataFrame:
        column, out = column or self.column, out or f"{self.column}_encoded"
        side = self.table.select(F.col("category").alias("__cat"), F.col("value").alias("__val"))
        joined = df.join(side, F.col(column).cast("string") == F.col("__cat"), "left")
        return joined.select(*[c for c in df.columns if c != out], F.coalesce("__val", F.lit(self.default)).alias(out))

    def save(self, path: str) -> None:
        self.table.write.mode("errorifexists").parquet(path)


def _category_counts(df: DataFrame, column: str, y: str) -> DataFrame:
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("category"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("s")))


def fit_target_encoder(df: DataFrame, column: str, y: str, k: float = 20.0, f: float = 10.0) -> CategoryTable:
    """Smoothed mean: l * mean + (1 - l) * prior with l = 1 / (1 + exp(-(n - k) / f)); unseen -> prior.

    A category seen once gets the prior.
    """
    prior = _lit_row(df.agg(F.avg(y).alias("p")))["p"]
    lam = 1 / (1 + F.exp(-(F.col("n") - k) / f))
    mean = F.col("s") / F.col("n")
    value = F.when(F.col("n") == 1, F.lit(prior)).otherwise(F.lit(prior) * (1 - lam) + mean * lam)
    return CategoryTable(_category_counts(df, column, y).select("category", value.alias("value")), column, prior)


def fit_m_estimate(df: DataFrame, column: str, y: str, m: float = 1.0) -> CategoryTable:
    """(sum_y + m * prior) / (n + m); missing and unseen categories stay null."""
    prior = _lit_row(df.agg(F.avg(y).alias("p")))["p"]
    value = (F.col("s") + m * prior) / (F.col("n") + m)
    return CategoryTable(_category_counts(df, column, y).select("category", value.alias("value")), column, None)


def m_estimate_out_of_fold(df: DataFrame, column: str, y: str, id_col: str, folds: int = 5, m: float = 1.0,
                           seed: int = 0, out: str | None = None) -> DataFrame:
    """M-estimate of each row's category from the other folds: totals minus the row's fold.

    One aggregation by (category, fold) and one join on both, which splits a hot category
    over its folds.
    """
    out = out or f"{column}_encoded"
    fold = F.pmod(portable_mix(id_col, seed), F.lit(folds)).cast("int")
    rows = df.withColumn("__fold", fold)
    part = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__cat"), F.col("__fold").alias("__f")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col(y).cast("double")).alias("__s"))
    totals = part.groupBy("__cat").agg(F.sum("__n").alias("__tn"), F.sum("__s").alias("__ts"))
    fold_prior = rows.groupBy(F.col("__fold").alias("__pf")).agg(F.count(F.lit(1)).alias("__pn"), F.sum(F.col(y).cast("double")).alias("__ps"))
    whole = fold_prior.agg(F.sum("__pn").alias("__wn"), F.sum("__ps").alias("__ws"))
    priors = fold_prior.crossJoin(F.broadcast(whole)).select("__pf", ((F.col("__ws") - F.col("__ps")) / (F.col("__wn") - F.col("__pn"))).alias("__prior"))
    n, s = F.col("__tn") - F.col("__n"), F.col("__ts") - F.col("__s")
    table = part.join(totals, "__cat").join(F.broadcast(priors), F.col("__f") == F.col("__pf")).select(
        "__cat", "__f", F.when(n > 0, (s + m * F.col("__prior")) / (n + m)).alias("__val"))
    joined = rows.join(table, (F.col(column) == F.col("__cat")) & (F.col("__fold") == F.col("__f")), "left")
    return joined.select(*df.columns, F.col("__val").alias(out))


def shared_vocabulary(df: DataFrame, model: CategoryTable, columns: list[str], row_id: str, out: str) -> DataFrame:
    """Encode several columns with the vocabulary fitted on one and keep the largest value.

    Rows are stacked once (one row per value), joined to the vocabulary once and brought back
    by their unique id.
    """
    long = df.select(row_id, F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("__v")).where("__v is not null")
    side = model.table.select(F.col("category").alias("__v"), F.col("value").alias("__e"))
    best = long.join(side, "__v").groupBy(row_id).agg(F.max("__e").alias(out))
    return df.join(best, row_id, "left")


def max_of(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Largest of the encoded columns (nulls skipped); the inputs are dropped."""
    return df.withColumn(out, F.greatest(*columns)).drop(*columns)


@dataclass
class NoiseAdder:
    """Gaussian noise of deviation sd/scale per column, drawn from the row id."""

    sigma: dict[str, float]
    row_id: str
    seed: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) + hash_normal(self.row_id, seed=self.seed + 2 * i) * F.lit(s)
                               for i, (c, s) in enumerate(sorted(self.sigma.items()))})


def fit_noise(df: DataFrame, columns: list[str], weight: str, row_id: str, scale: float = 3.0, seed: int = 0) -> NoiseAdder:
    r = _lit_row(df.agg(*[weighted_std(F.col(c), F.col(weight)).alias(c) for c in columns]))
    return NoiseAdder({c: (r[c] or 0.0) / scale for c in columns}, row_id, seed)


def noise_scale(prior: float) -> float:
    """sqrt(p (1 - p)) rounded to two digits: the deviation used by the noisy encoder."""
    return round((prior * (1 - prior)) ** 0.5, 2)


def randomised(df: DataFrame, column: str, row_id: str, sigma: float, seed: int = 0) -> DataFrame:
    """The encoded column times a normal draw of mean 1 and deviation ``sigma``, fixed by the row id; for training rows only."""
    return df.withColumn(column, F.col(column) * (1 + hash_normal(row_id, seed=seed) * F.lit(sigma)))


# ---- rare categories and one-hot -----------------------------------------------------------

@dataclass
class RareGrouper:
    column: str
    frequent: list[str] | None
    label: str = "Rare"

    def transform(self, df: DataFrame) -> DataFrame:
        if self.frequent is None:
            return df
        c = F.col(self.column)
        return df.withColumn(self.column, F.when(c.isNull() | c.isin(*self.frequent), c).otherwise(self.label))


def fit_rare(df: DataFrame, column: str, tol: float, n_categories: int) -> RareGrouper:
    """Group categories below share ``tol`` when there are more than ``n_categories``.

    At most 1/tol categories can reach the share, so the kept list is bounded by the argument.
    """
    if not 0 < tol < 1:
        raise ValueError("tol must lie in (0, 1)")
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).first()
    if (total["k"] or 0) <= n_categories:
        return RareGrouper(column, None)
    kept = counts.where(F.col("n") >= tol * total["t"]).orderBy(column).collect()
    return RareGrouper(column, [r[0] for r in kept])


@dataclass
class OneHot:
    column: str
    values: list[str]
    names: list[str] = field(default_factory=list)

    def columns(self) -> list[Column]:
        return [F.when(F.col(self.column) == v, 1).otherwise(0).alias(n) for v, n in zip(self.values, self.names)]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *self.columns())


def fit_one_hot(df: DataFrame, column: str, limit: int = 2000) -> OneHot:
    """0/1 columns ``column_value`` for the fitted values; unknown values give zeros.

    The output width is the number of values, so more than ``limit`` of them is an error
    (group rare ones first) rather than a silent cut.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values; group rare categories first")
    values = sorted(r["v"] for r in rows)
    return OneHot(column, values, [f"{column}_{v}" for v in values])


def one_hot_dictionary(df: DataFrame, column: str, n_chunks: int | None = None) -> DataFrame:
    """Levels of ``column`` in order with their places: (value, place from 0). A table, so any number of levels will do."""
    levels = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    # the first six bytes as a number lead the order of texts, by which the scan is cut into chunks
    head = F.conv(F.substring(F.rpad(F.hex(F.encode("value", "UTF-8")), 12, "0"), 1, 12), 16, 10).cast("double")
    ranked = row_numbers(levels.withColumn("__head", head), [], ["__head", "value"], "__rn", n_chunks=n_chunks)
    return ranked.select("value", (F.col("__rn") - 1).cast("long").alias("place"))


def one_hot_vectors(df: DataFrame, column: str, dictionary: DataFrame, out: str | None = None) -> DataFrame:
    """Add ``{column}_vec`` (or ``out``), the sparse 0/1 vector of each row: a struct of indices and values.

    Null and unknown values give empty vectors. The width is the number of rows of ``dictionary``,
    which is joined, never collected.
    """
    found = dictionary.select(F.col("value").alias("__value"), F.col("place").alias("__place"))
    rows = df.join(found, F.col(column).cast("string") == F.col("__value"), "left")
    some = F.col("__place").isNotNull()
    vector = F.struct(F.when(some, F.array("__place")).otherwise(F.array().cast("array<bigint>")).alias("indices"),
                      F.when(some, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"))
    return rows.withColumn(out or f"{column}_vec", vector).drop("__value", "__place")
