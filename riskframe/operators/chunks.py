"""Ordered scans that never put one key, or the whole table, in one task.

A plain window over ``partitionBy(key)`` sends all rows of a key to one task, and a window
with no key sends everything. Here the order axis is first cut at approximate quantiles of
the data, so a chunk holds about 1/n of all rows whatever the key distribution is. The
window runs inside (key, chunk); chunk totals (at most n rows a key) carry the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

CHUNKS = None  # chosen from the session, see ``chunk_count``
SMALL = 10_000  # rows of a totals table that may be broadcast


def chunk_count(df: DataFrame, n: int | None = None) -> int:
    """Chunks of a scan: a few per shuffle partition, so that the whole cluster works even on
    one key, within what one sketch can resolve."""
    if n is not None:
        return n
    return min(max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 10_000)


def split_points(df: DataFrame, order_col: str, n: int) -> list[float]:
    """Inner cut points of ``order_col`` at n-quantiles; at most n-1 numbers reach the driver."""
    probs = [i / n for i in range(1, n)]
    row = df.agg(
        F.percentile_approx(F.col(order_col).cast("double"), F.array(*map(F.lit, probs)), 10 * n).alias("p")
    ).first()
    return sorted(set(row["p"] or []))


def with_chunk(df: DataFrame, order_col: str, points: list[float], out: str = "__chunk") -> DataFrame:
    """Add the chunk number of ``order_col``; it never decreases along the order."""
    if not points:
        return df.withColumn(out, F.lit(0))
    tmp = "__chunk_src"
    bucketizer = Bucketizer(
        splits=[float("-inf"), *points, float("inf")], inputCol=tmp, outputCol=out, handleInvalid="keep"
    )
    return (
        bucketizer.transform(df.withColumn(tmp, F.col(order_col).cast("double")))
        .drop(tmp)
        .withColumn(out, F.col(out).cast("int"))
    )


def _same_keys(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def _in_chunk(kind: str, value: Column) -> Column:
    return {
        "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
        "last": lambda c: F.last(c, ignorenulls=True),
    }[kind](value)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    aggs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    chunk_col: str | None = None,
    n_chunks: int | None = CHUNKS,
) -> DataFrame:
    """Running aggregates along ``order`` within ``keys``.

    ``aggs`` maps an output name to (kind, column), kind one of sum, count, min, max, last
    (last non-null). ``inclusive`` counts the current row. The order must be total, since
    frames are by row; null keys form groups like other values. ``chunk_col`` is the numeric leading order column used for chunking
    (default: ``order[0]``, which must then be an ascending numeric column name).
    """
    chunk_col = chunk_col or order[0]
    own_keys = [f"__key{i}" for i in range(len(keys))]
    df_columns = df.columns
    df = df.select("*", *[F.struct(F.col(k)).alias(c) for k, c in zip(keys, own_keys)])  # a struct is never null, whatever it holds
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    chunked = with_chunk(df, chunk_col, split_points(df, chunk_col, chunk_count(df, n_chunks)))
    inside = W.partitionBy(*own_keys, "__chunk").orderBy(*order_cols).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1
    )
    rows = chunked.select(
        "*", *[_in_chunk(kind, value).over(inside).alias(f"__in_{name}") for name, (kind, value) in aggs.items()]
    )

    def total(kind: str, value: Column) -> Column:
        if kind == "last":
            return F.max_by(value, F.when(value.isNotNull(), F.struct(*order_cols)))
        return _in_chunk(kind, value)

    carried_keys = [f"__k{i}" for i in range(len(keys))]
    totals = chunked.groupBy(*[F.col(k).alias(c) for k, c in zip(own_keys, carried_keys)],
                             F.col("__chunk").alias("__c")).agg(
        *[total(kind, value).alias(f"__t_{name}") for name, (kind, value) in aggs.items()]
    )
    across = W.partitionBy(*(carried_keys or [F.lit(0)])).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    across_kind = {"count": "sum"}
    carry = totals.select(
        *carried_keys, "__c",
        *[_in_chunk(across_kind.get(kind, kind), F.col(f"__t_{name}")).over(across).alias(f"__pre_{name}")
          for name, (kind, _) in aggs.items()],
    )
    if not keys:
        carry = F.broadcast(carry)  # one row per chunk, at most n_chunks rows
    # plain equality keeps the hash layout of the window, so the rows are not shuffled again
    cond = reduce(lambda a, b: a & b,
                  [F.col(x) == F.col(y) for x, y in zip([*own_keys, "__chunk"], [*carried_keys, "__c"])])
    joined = rows.join(carry, cond, "left")

    def combine(name: str, kind: str) -> Column:
        a, b = F.col(f"__in_{name}"), F.col(f"__pre_{name}")
        if kind == "count":
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        if kind == "sum":
            return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        return {"min": F.least, "max": F.greatest, "last": F.coalesce}[kind](a, b)

    return joined.select(*df_columns, *[combine(name, kind).alias(name) for name, (kind, _) in aggs.items()])


def row_numbers(df: DataFrame, keys: list[str], order: list[str | Column], out: str = "rn",
                chunk_col: str | None = None, n_chunks: int | None = CHUNKS) -> DataFrame:
    """``row_number()`` per key, or over the whole table when ``keys`` is empty."""
    return running(df, keys, order, {out: ("count", F.lit(1))}, True, chunk_col, n_chunks)


def group_sizes(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def attach_totals(df: DataFrame, keys: list[str], totals: DataFrame) -> DataFrame:
    """Join per-key totals back to rows.

    The totals are checkpointed and counted: up to ``SMALL`` rows they are broadcast, so rows
    of a few big groups are not shuffled on their group; more go through a planned join.
    """
    if not keys:
        return df.crossJoin(F.broadcast(totals))  # exactly one row
    totals = cut_lineage(totals)
    if totals.count() <= SMALL:
        totals = F.broadcast(totals)
    names = [f"__t{i}" for i in range(len(keys))]
    right = totals.select(*[F.col(k).alias(n) for k, n in zip(keys, names)],
                          *[c for c in totals.columns if c not in keys])
    return df.join(right, _same_keys(keys, names), "left").drop(*names)


def ntiles(df: DataFrame, keys: list[str], order: list[str | Column], n: int, out: str = "tile",
           chunk_col: str | None = None, n_chunks: int | None = CHUNKS) -> DataFrame:
    """``ntile(n)`` from chunked row numbers and the group size."""
    ranked = row_numbers(df, keys, order, "__rn", chunk_col, n_chunks)
    sized = attach_totals(ranked, keys, group_sizes(df, keys, "__n"))
    q, r = F.floor(F.col("__n") / n), F.col("__n") % n
    zero = F.col("__rn") - 1
    wide = r * (q + 1)
    tile = F.when(zero < wide, F.floor(zero / (q + 1))).otherwise(
        r + F.floor(F.try_divide(zero - wide, q))) + 1
    return sized.withColumn(out, tile.cast("int")).drop("__rn", "__n")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    names: list[str] | None = None, n_chunks: int | None = CHUNKS, weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles per key, as pandas and ``percentile`` define them.

    Distinct values are counted first (map-side combined) and checkpointed, then ranked in
    chunks, so no task holds a whole group. One output row per key. ``weight`` is the number
    of equal rows that a row stands for.
    """
    names = names or [f"q{int(round(p * 100)):03d}" for p in probs]
    v = F.col(value).cast("double")
    copies = F.col(weight) if weight else F.lit(1)
    counted = cut_lineage(df.select(*keys, v.alias("__v"), copies.alias("__w")).where("__v is not null and not isnan(__v)")
                          .groupBy(*keys, "__v").agg(F.sum("__w").alias("__cnt")))
    cum = running(counted, keys, ["__v"], {"__cum": ("sum", F.col("__cnt"))}, True, None, n_chunks)
    sized = attach_totals(cum, keys, counted.groupBy(*keys).agg(F.sum("__cnt").alias("__n")))
    first, n = F.col("__cum") - F.col("__cnt"), F.col("__n")

    def at(index: Column) -> Column:
        return F.max(F.when((first <= index) & (index < F.col("__cum")), F.col("__v")))

    picked = sized.groupBy(*keys).agg(
        F.max("__n").alias("__n"),
        *[at(F.floor(F.lit(p) * (n - 1))).alias(f"__lo{i}") for i, p in enumerate(probs)],
        *[at(F.ceil(F.lit(p) * (n - 1))).alias(f"__hi{i}") for i, p in enumerate(probs)],
    )

    def value_of(i: int, p: float) -> Column:
        frac = F.lit(p) * (n - 1) - F.floor(F.lit(p) * (n - 1))
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        return lo + frac * (hi - lo)

    return picked.select(*keys, *[value_of(i, p).alias(nm) for i, (p, nm) in enumerate(zip(probs, names))])
