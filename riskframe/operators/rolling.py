"""Exact exclusive rolling windows per entity, without sliding frames.

For a row at time t and a window h, rows in [t-h, t) are split on a fixed bucket grid
(bucket <= h, h a multiple of it) into three parts:

* tail   - rows of t's own bucket before t,
* middle - whole buckets in between, taken from per-bucket partial aggregates,
* head   - rows of bucket(t-h) at or after t-h. A row at s is copied once per window to
  bucket(s+h) with position s+h; there the head is "copies with position >= t".

Tail and head are growing frames inside (entity, bucket), linear in the rows (sliding
frames re-read the window for each row), and a hot entity spreads over its buckets. All
windows of one call share one shuffle on (entity, bucket).

Buckets are counted first. One with more than ``BLOCK`` rows and copies is cut at quantiles of their positions into
blocks; frames grow inside a block, and the totals of the blocks before or after it are carried
in. So no bucket is one task, however busy its entity is; results are the same.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage
from .timekeys import MICROS, floor_bucket, micros

BLOCK = 1_000_000  # rows and copies of a bucket that one task scans
PIECES = 1000  # blocks of a bucket at most, and busy buckets whose cuts are broadcast

# Partial aggregates each measure is assembled from.
PARTS = {
    "sum": ("sum",), "count": ("cnt",), "min": ("min",), "max": ("max",),
    "mean": ("sum", "cnt"), "std": ("sum", "cnt", "ssq"),
}


@dataclass(frozen=True)
class Rolling:
    """One output column: ``agg`` of ``value`` (rows where it is null do not count)."""

    name: str
    agg: str
    value: str
    seconds: int


def _part(part: str, c: Column) -> Column:
    if part == "ssq":
        return F.sum(c * c)
    return {"sum": F.sum, "cnt": F.count, "min": F.min, "max": F.max}[part](c)


def _merge(part: str, pieces: list[Column]) -> Column:
    if part in ("min", "max"):
        return (F.least if part == "min" else F.greatest)(*pieces)
    total = sum((F.coalesce(p, F.lit(0)) for p in pieces[1:]), F.coalesce(pieces[0], F.lit(0)))
    return total if part == "cnt" else F.when(F.coalesce(*pieces).isNull(), F.lit(None)).otherwise(total)


def _busy_cuts(base: DataFrame, spread: DataFrame, keys: list[str], windows: list[int], width: int, block: int) -> DataFrame | None:
    """Positions that cut each busy bucket into blocks: (keys, __bkt, __cuts); None if no bucket is busy.

    A bucket gets its own rows and one copy of those of the bucket a window before it, for each
    window, so a bucket's own rows are counted and its copies' buckets follow.
    """
    share = max(1, block // (len(windows) + 1))
    counts = base.groupBy(*keys, floor_bucket(F.col("__ts"), width).alias("__b")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > share)
    counts = cut_lineage(counts)
    most = counts.agg(F.max("__n")).first()[0]
    if most is None:
        return None
    moves = F.array(*[F.lit(h * MICROS // width) for h in (0, *windows)])
    busy = counts.select(*keys, F.explode(F.transform(moves, lambda m: F.col("__b") + m)).alias("__bkt")).distinct()
    pieces = min(PIECES, -(-most * (len(windows) + 1) // block) * 2)
    probs = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    cuts = spread.select(*keys, "__bkt", "__pos").join(busy, [*keys, "__bkt"], "left_semi").groupBy(*keys, "__bkt").agg(
        F.array_distinct(F.percentile_approx("__pos", probs, 10 * pieces)).alias("__cuts"))
    cuts = cut_lineage(cuts)
    return F.broadcast(cuts) if cuts.count() <= PIECES else cuts


def add_rolling(df: DataFrame, keys: list[str], ts: str, measures: list[Rolling], bucket: int,
                values: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """Append the rolling ``measures`` to every row of ``df``; counts the buckets at once.

    ``bucket`` is in seconds; every window must be a multiple of it. ``values`` gives the
    expressions behind the measures' value names (plain column names need no entry).
    Rows at the same microsecond do not see each other.
    """
    values = values or {}
    windows = sorted({m.seconds for m in measures})
    for h in windows:
        if h % bucket:
            raise ValueError(f"window {h}s is not a multiple of the bucket {bucket}s")
    width = bucket * MICROS
    used = sorted({m.value for m in measures})
    need = sorted({(p, m.value) for m in measures for p in PARTS[m.agg]})
    need_by_window = {h: sorted({(p, m.value) for m in measures if m.seconds == h for p in PARTS[m.agg]})
                      for h in windows}

    pos = micros(ts)
    own_keys = [f"__key{i}" for i in range(len(keys))]  # structs, which join and group null keys like other values
    base = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("__row"), *[F.struct(F.col(k)).alias(c) for k, c in zip(keys, own_keys)],
                     pos.alias("__ts"), *[values.get(v, F.col(v)).alias(f"__v_{v}") for v in used])
    val = {v: F.col(f"__v_{v}") for v in used}

    copies = F.array(*[F.struct(F.lit(i).alias("role"), (F.col("__ts") + F.lit(h * MICROS)).alias("pos"))
                       for i, h in enumerate([0, *windows])])
    spread = (base.withColumn("__cp", F.explode(copies))
              .select(*own_keys, *[f"__v_{v}" for v in used],
                      F.col("__cp.role").alias("__role"), F.col("__cp.pos").alias("__pos"),
                      F.when(F.col("__cp.role") == 0, F.col("__row")).alias("__row"))
              .withColumn("__bkt", floor_bucket(F.col("__pos"), width)))

    def masked(role: int, v: str) -> Column:
        return F.when(F.col("__role") == role, val[v])

    busy = _busy_cuts(base, spread, own_keys, windows, width, block)
    if busy is not None:
        spread = spread.join(busy, [*own_keys, "__bkt"], "left").withColumn(
            "__sub", F.coalesce(F.size(F.filter("__cuts", lambda c: c <= F.col("__pos"))), F.lit(0))).withColumn("__cut", F.col("__cuts").isNotNull()).drop("__cuts")

    grid = W.partitionBy(*own_keys, "__bkt", *(["__sub"] if busy is not None else []))
    tail = grid.orderBy("__pos").rangeBetween(W.unboundedPreceding, -1)
    head = grid.orderBy(F.col("__neg")).rangeBetween(W.unboundedPreceding, 0)
    tails = spread.withColumn("__neg", -F.col("__pos")).select(
        "*", *[_part(p, masked(0, v)).over(tail).alias(f"__t_{p}_{v}") for p, v in need])
    heads = tails.select(
        "*", *[_part(p, masked(i, v)).over(head).alias(f"__h{h}_{p}_{v}")
               for i, h in enumerate(windows, 1) for p, v in need_by_window[h]]
    ).where("__role = 0")

    if busy is not None:
        totals = spread.where("__cut").groupBy(*own_keys, "__bkt", "__sub").agg(
            *[_part(p, masked(0, v)).alias(f"__t_{p}_{v}") for p, v in need],
            *[_part(p, masked(i, v)).alias(f"__h{h}_{p}_{v}") for i, h in enumerate(windows, 1) for p, v in need_by_window[h]])
        blocks = W.partitionBy(*own_keys, "__bkt").orderBy("__sub")  # at most ``PIECES`` rows
        before, after = blocks.rowsBetween(W.unboundedPreceding, -1), blocks.rowsBetween(1, W.unboundedFollowing)
        over = lambda c, p, w: {"min": F.min, "max": F.max}.get(p, F.sum)(c).over(w).alias(f"__c{c}")
        carry = totals.select(*[F.col(k).alias(f"__j_{k}") for k in (*own_keys, "__bkt", "__sub")],
                              *[over(f"__t_{p}_{v}", p, before) for p, v in need],
                              *[over(f"__h{h}_{p}_{v}", p, after) for h in windows for p, v in need_by_window[h]])
        same = [F.col(k) == F.col(f"__j_{k}") for k in (*own_keys, "__bkt", "__sub")]
        heads = heads.join(carry, reduce(lambda a, b: a & b, same), "left")

    multi = [h for h in windows if h > bucket]
    partial_cols = {(p, v): F.col(f"__p_{p}_{v}") for p, v in need}
    if multi:
        partials = base.groupBy(*own_keys, floor_bucket(F.col("__ts"), width).alias("__bkt")).agg(
            *[_part(p, val[v]).alias(f"__p_{p}_{v}") for p, v in need])
        per_key = W.partitionBy(*own_keys).orderBy("__bkt")

        def middle(h: int, p: str, v: str) -> Column:
            frame = per_key.rangeBetween(-(h // bucket) + 1, -1)
            merge = {"min": F.min, "max": F.max}.get(p, F.sum)
            return merge(partial_cols[(p, v)]).over(frame).alias(f"__m{h}_{p}_{v}")

        mids = partials.select(*[F.col(k).alias(f"__k_{k}") for k in own_keys], F.col("__bkt").alias("__mb"),
                               *[middle(h, p, v) for h in multi for p, v in need_by_window[h]])
        cond = F.col("__bkt") == F.col("__mb")
        for k in own_keys:
            cond = cond & (F.col(k) == F.col(f"__k_{k}"))  # same hash layout as the windows: no new shuffle
        heads = heads.join(mids, cond, "left")

    def piece(p: str, m: Rolling) -> Column:
        names = [f"__t_{p}_{m.value}", f"__h{m.seconds}_{p}_{m.value}"]
        parts = [F.col(n) for n in names] + ([F.col(f"__c{n}") for n in names] if busy is not None else [])
        if m.seconds > bucket:
            parts.append(F.col(f"__m{m.seconds}_{p}_{m.value}"))
        return _merge(p, parts)

    def final(m: Rolling) -> Column:
        if m.agg == "mean":
            return F.try_divide(piece("sum", m), piece("cnt", m))
        if m.agg == "std":
            s, n, q = piece("sum", m), piece("cnt", m), piece("ssq", m)
            var = F.try_divide(q - s * F.try_divide(s, n), n - 1)
            return F.when(var > 0, F.sqrt(var)).when(var.isNotNull(), F.lit(0.0))
        return piece(PARTS[m.agg][0], m)

    return heads.select(*[F.col(f"__row.{c}").alias(c) for c in df.columns],
                        *[final(m).alias(m.name) for m in measures])
