"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a document of a source is wanted ``target /
source size`` times. The whole part of that is taken for certain. The fractions are rounded
jointly: two documents trade words until one of them is taken or left, and the other carries
the remaining fraction to its next partner. A trade keeps the expected copies of each document
and, exactly, the expected words of the source, so a source misses its target by less than one
document.

Trades run in buckets of about ``FAN_IN`` documents of a source; each bucket leaves at most one
undecided document, and these meet in a tree whose depth is the logarithm of the number of
documents. No group grows with a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import free_name, materialise, n_words, uniform

FAN_IN = 64
SEED = 20240607
CLOSE = 1e-9  # a fraction this near to 0 or 1 counts as whole

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2


def _positions(sources: DataFrame) -> DataFrame:
    """Add ``position``: 0, 1, ... by code point, null last, without one task for all sources."""
    parts = materialise(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    counts = parts.groupBy("part").count()  # one row per partition
    before = counts.select(
        "part", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    rank = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("rank", rank).join(before, "part").withColumn("position", F.col("rank") + F.col("before")).drop("part", "rank", "before")


def targets(items: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: ``source_size``, ``n_items`` and ``target`` words.

    Sources weigh ``weights`` in turn by code point order, null last, and share ``share`` times
    all words. A target stops at ``cap`` times the source's size; what is left over is shared
    again by weight until no target is above. ``items`` has source, size and m (equal rows).
    """
    totals = items.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n_items")
    )
    array = F.array(*[F.lit(float(w)) for w in weights])
    ranked = _positions(totals).withColumn("weight", F.get(array, (F.col("position") % len(weights)).cast("int")))
    ranked = materialise(ranked.drop("position"), "mix-weights")
    limit = F.col("source_size") * cap
    wanted = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # words per unit of weight; only ever rises, and each rise caps at least one more source
    while True:
        stopped = limit < F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum(F.when(stopped, limit)).alias("stopped"), F.sum(F.when(~stopped, F.col("weight"))).alias("open")
        ).first()
        higher = (wanted - (row["stopped"] or 0)) / row["open"] if row["open"] else level
        if higher <= level:
            break
        level = higher
    return ranked.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def _trade(held: Column, new: Column) -> tuple[Column, Column]:
    """Fractions of two documents after one trade; at least one of them is 0 or 1."""
    p, s, q, t = held["p"], held["s"], new["p"], new["s"]
    up, down = F.least((1 - p) * s, q * t), F.least(p * s, (1 - q) * t)
    rise = new["u"] * (up + down) < down  # the held document gains with probability down / (up + down)
    p_up = F.when((1 - p) * s <= q * t, F.lit(1.0)).otherwise(p + q * t / s)
    q_down = F.when((1 - p) * s < q * t, q - (1 - p) * s / t).otherwise(F.lit(0.0))
    p_down = F.when(p * s <= (1 - q) * t, F.lit(0.0)).otherwise(p - (1 - q) * t / s)
    q_up = F.when(p * s < (1 - q) * t, q + p * s / t).otherwise(F.lit(1.0))
    return F.when(rise, p_up).otherwise(p_down), F.when(rise, q_down).otherwise(q_up)


_OPEN = "struct<i:int,p:double,s:double,u:double>"
_DONE = "array<struct<i:int,up:int>>"


def _chain(items: Column) -> Column:
    """Fold a bucket: struct(held, done) with the undecided document and the decided ones."""

    def whole(p: Column) -> Column:
        return (p < CLOSE) | (p > 1 - CLOSE)

    def decided(i: Column, p: Column) -> Column:
        return F.when(whole(p), F.array(F.struct(i.alias("i"), F.round(p).cast("int").alias("up")))).otherwise(
            F.array().cast(_DONE)
        )

    def open_(i, p, s, u) -> Column:
        return F.struct(i.alias("i"), p.alias("p"), s.alias("s"), u.alias("u"))

    def step(acc: Column, new: Column) -> Column:
        held = acc["held"]
        first = F.struct(open_(new["i"], new["p"], new["s"], new["u"]).alias("held"), acc["done"].alias("done"))
        p, q = _trade(held, new)

        def close(x: Column) -> Column:
            a = open_(held["i"], x["p"], held["s"], held["u"])
            b = open_(new["i"], x["q"], new["s"], new["u"])
            rest = F.when(~whole(x["p"]), a).when(~whole(x["q"]), b)
            done = F.concat(acc["done"], decided(held["i"], x["p"]), decided(new["i"], x["q"]))
            return F.struct(rest.alias("held"), done.alias("done"))

        traded = F.transform(F.array(F.struct(p.alias("p"), q.alias("q"))), close)[0]
        return F.when(held.isNull(), first).otherwise(traded)

    start = F.struct(F.lit(None).cast(_OPEN).alias("held"), F.array().cast(_DONE).alias("done"))
    return F.aggregate(items, start.cast(f"struct<held:{_OPEN},done:{_DONE}>"), lambda a, x: step(a, x).cast(f"struct<held:{_OPEN},done:{_DONE}>"))


def decide(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS,
           share: float = SHARE, cap: float = CAP, seed: int = SEED, fan_in: int = FAN_IN) -> DataFrame:
    """Copies to take of each document.

    Returns one row per distinct (id, source, size): ``doc_id``, ``source``, ``size``, ``m``
    (rows that share these values), ``source_size``, ``target``, ``base`` (copies each of them
    gets) and ``extra`` (how many of them get one more). Null text has size 0 and is never
    taken; null ids and sources are values like others. Equal rows are interchangeable: among m
    of them the trades have a closed form, floor(m p) gain and one keeps the rest.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    items = materialise(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "mix-items")
    stats = targets(items, weights, share, cap).select(
        F.col("source").alias("s_source"), "source_size", "n_items", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("want"),
    )
    stats = materialise(stats, "mix-targets")
    most = stats.agg(F.max("n_items")).first()[0] or 0
    c = items.join(stats, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    c = c.withColumn("base", F.floor(F.col("want") + CLOSE).cast("int"))
    c = c.withColumn("mass", F.when(F.col("size") > 0, F.greatest(F.col("want") - F.col("base"), F.lit(0.0)) * F.col("m")).otherwise(0.0))
    c = c.withColumn("sure", F.floor(F.col("mass") + CLOSE).cast("long")).withColumn("p", F.greatest(F.col("mass") - F.col("sure"), F.lit(0.0)))
    fields = ["doc_id", "size", "m", "source_size", "target", "base", "sure"]
    c = c.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id", "size"), F.ceil(F.col("n_items") / fan_in)))
    c = c.select("source", *fields, "p", "bucket")
    decided = [c.where(F.col("p") < CLOSE).select("source", *fields, F.lit(0).alias("up"))]
    open_, level, buckets = c.where(F.col("p") >= CLOSE), 0, -(-most // fan_in)
    while True:
        # long documents first: they trade among themselves, and the fraction left over is of a short one
        item = F.struct((-F.col("size")).alias("o"), F.xxhash64(F.lit(seed + level), "source", "doc_id", "size").alias("h"), *fields, "p",
                        uniform(seed, level, F.col("source"), F.col("doc_id"), F.col("size")).alias("u"))
        grouped = open_.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(item)).alias("items"))
        numbered = F.transform("items", lambda x, i: F.struct(i.alias("i"), x["p"].alias("p"), x["size"].cast("double").alias("s"), x["u"].alias("u")))
        chained = grouped.select("source", "bucket", "items", _chain(numbered).alias("out"))
        rest = F.when(F.col("out.held").isNotNull(), F.array(F.struct(F.col("out.held.i").alias("i"), F.lit(None).cast("int").alias("up"), F.col("out.held.p").alias("p"))))
        done = F.transform("out.done", lambda x: F.struct(x["i"].alias("i"), x["up"].alias("up"), F.lit(None).cast("double").alias("p")))
        rows = chained.select("source", "bucket", "items", F.explode(F.concat(done, F.coalesce(rest, F.array().cast("array<struct<i:int,up:int,p:double>>")))).alias("x"))
        rows = rows.withColumn("item", F.get("items", F.col("x.i"))).select("source", "bucket", *[F.col(f"item.{f}").alias(f) for f in fields], F.col("x.up").alias("up"), F.col("x.p").alias("p"))
        rows = materialise(rows, f"mix-level{level}")
        decided.append(rows.where(F.col("up").isNotNull()).select("source", *fields, "up"))
        open_ = rows.where(F.col("up").isNull()).drop("up").withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        if buckets <= 1:
            break
        level, buckets = level + 1, -(-buckets // fan_in)
    last = (uniform(seed, -1, F.col("source"), F.col("doc_id"), F.col("size")) < F.col("p")).cast("int")
    decided.append(open_.select("source", *fields, last.alias("up")))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.withColumn("extra", F.col("sure") + F.col("up")).drop("sure", "up")


def report(decisions: DataFrame) -> DataFrame:
    """One row per document: sizes, the target of its source and the words taken of it."""
    rows = decisions.withColumn("r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    copies = F.col("base") + F.when(F.col("r") <= F.col("extra"), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), "source", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str = "copy", **options) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, numbered in ``copy_col``.

    All columns are kept; documents taken zero times (empty ones too) are gone. Extra columns may
    have any name. An empty table stays empty.
    """
    size, key, number, m = free_name(docs, "size", "key", "number", "m")
    picks = decide(docs, id_col, source_col, text_col, **options).select(
        F.col("doc_id").alias(f"{key}_id"), F.col("source").alias(f"{key}_source"), F.col("size").alias(f"{key}_size"),
        F.col("m"), F.col("base").alias(f"{key}_base"), F.col("extra").alias(f"{key}_extra"),
    ).withColumnRenamed("m", m)
    picks = picks.where((F.col(f"{key}_size") > 0) & (F.col(f"{key}_base") + F.col(f"{key}_extra") > 0))
    rows = docs.withColumn(size, n_words(F.col(text_col)))
    rows = rows.join(picks, rows[id_col].eqNullSafe(picks[f"{key}_id"]) & rows[source_col].eqNullSafe(picks[f"{key}_source"]) & (rows[size] == picks[f"{key}_size"]))
    one = rows.where(F.col(m) == 1).withColumn(number, F.lit(1))
    window = W.partitionBy(f"{key}_id", f"{key}_source", f"{key}_size").orderBy(F.xxhash64(F.col(text_col)))
    many = rows.where(F.col(m) > 1).withColumn(number, F.row_number().over(window))
    rows = one.unionByName(many)
    copies = F.col(f"{key}_base") + F.when(F.col(number) <= F.col(f"{key}_extra"), 1).otherwise(0)
    rows = rows.where(copies > 0).withColumn(copy_col, F.explode(F.sequence(F.lit(1), copies)))
    return rows.select(*docs.columns, copy_col)
