"""Chunked scans, as-of and interval joins and rolling windows against brute force, with one
hot key, ties and several partitionings."""

import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import asof, chunks, interval
from riskframe.operators.rolling import Rolling, add_rolling

MICRO = 1_000_000


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 else f"k{rng.randrange(12)}"
        at = rng.randrange(0, 4 * 24 * 3600) * MICRO + rng.choice([0, 0, 1])
        if i % 50 == 0:
            at = 7200 * MICRO * rng.randrange(1, 20)  # ties, and rows exactly two hours apart
        rows.append((i, key, at, None if i % 7 == 0 else round(rng.uniform(0, 100), 2)))
    df = spark.createDataFrame(rows, "id long, key string, us long, v double").withColumn("ts", F.timestamp_micros("us"))
    return rows, df


def brute(rows, span):
    out = {}
    for i, k, t, _ in rows:
        vals = [v for _, k2, t2, v in rows if k2 == k and t - span <= t2 < t and v is not None]
        out[i] = (len(vals), round(sum(vals), 6) if vals else None, max(vals) if vals else None, min(vals) if vals else None)
    return out


@pytest.mark.parametrize("bucket", [1800, 7200])
def test_rolling_equals_brute_force(events, bucket):
    rows, df = events
    spans = {"2h": 7200, "48h": 48 * 3600}
    ms = [Rolling(f"{a}_{n}", a, "v", s) for n, s in spans.items() for a in ("count", "sum", "max", "min")]
    got = {r["id"]: r for r in add_rolling(df, ["key"], "ts", ms, bucket).collect()}
    assert len(got) == len(rows)
    for n, s in spans.items():
        want = brute(rows, s * MICRO)
        for i, (c, total, hi, lo) in want.items():
            r = got[i]
            assert r[f"count_{n}"] == c and r[f"max_{n}"] == hi and r[f"min_{n}"] == lo
            assert (r[f"sum_{n}"] is None) == (total is None)
            assert total is None or abs(r[f"sum_{n}"] - total) < 1e-6


@pytest.mark.parametrize("block", [3, 60, 10**6])
def test_busy_buckets_are_cut(spark, block):
    """One account holds half the rows, a third of them at one instant and all within a few buckets."""
    import numpy as np

    rng = np.random.default_rng(8)
    t = [*rng.integers(0, 3 * 3600 * MICRO, 150).tolist(), *[3600 * MICRO] * 80, *rng.integers(0, 90 * 3600 * MICRO, 230).tolist()]
    rows = [(i, "busy" if i < 230 else rng.choice(["a", "b", None]), int(us), None if i % 5 == 0 else float(i % 13)) for i, us in enumerate(t)]
    df = spark.createDataFrame([(i, None if k is None else str(k), us, v) for i, k, us, v in rows], "id long, key string, us long, v double").withColumn("ts", F.timestamp_micros("us"))
    ms = [Rolling(f"{a}_{n}", a, "v", s) for n, s in (("2h", 7200), ("48h", 172800)) for a in ("count", "sum", "max", "min", "mean", "std")]
    got = {r["id"]: r for r in add_rolling(df, ["key"], "ts", ms, 7200, block=block).collect()}
    for n, span in (("2h", 7200), ("48h", 172800)):
        for i, (c, total, hi, lo) in brute(rows, span * MICRO).items():
            r = got[i]
            assert (r[f"count_{n}"], r[f"max_{n}"], r[f"min_{n}"]) == (c, hi, lo)
            assert (r[f"sum_{n}"] is None) == (total is None) and (total is None or abs(r[f"sum_{n}"] - total) < 1e-6)
            assert total is None or abs(r[f"mean_{n}"] - total / c) < 1e-6


def test_no_block_is_much_larger_than_asked(spark):
    from riskframe.operators import rolling

    one = spark.range(40_000).select(F.lit("busy").alias("key"), (F.col("id") * 100_000).alias("__pos"))
    few = spark.range(400).select(F.concat(F.lit("k"), F.col("id") % 20).alias("key"), (F.col("id") * 9_000_000).alias("__pos"))
    base = one.union(few).withColumn("__ts", F.col("__pos"))
    width = 7200 * MICRO
    spread = base.withColumn("__bkt", F.floor(F.col("__pos") / width))
    cuts = rolling._busy_cuts(base, spread, ["key"], [7200], width, 2000)
    marked = spread.join(cuts, ["key", "__bkt"], "left").withColumn("sub", F.coalesce(F.size(F.filter("__cuts", lambda c: c <= F.col("__pos"))), F.lit(0)))
    sizes = marked.groupBy("key", "__bkt", "sub").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2000
    assert cuts.select("key").distinct().count() == 1


def test_rolling_rejects_uneven_bucket(events):
    with pytest.raises(ValueError):
        add_rolling(events[1], ["key"], "ts", [Rolling("x", "sum", "v", 5000)], 1800)


@pytest.mark.parametrize("n_chunks", [1, 3, 64])
def test_running_is_the_same_for_any_chunking(events, n_chunks):
    rows, df = events
    out = chunks.running(df, ["key"], ["us", "id"], {"s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "l": ("last", F.col("v"))},
                         inclusive=False, n_chunks=n_chunks).collect()
    assert len(out) == len(rows)
    for r in out:
        before = sorted((t, i, v) for i, k, t, v in rows if k == r["key"] and (t, i) < (r["us"], r["id"]))
        vals = [v for _, _, v in before if v is not None]
        assert r["n"] == len(before)
        assert r["l"] == (vals[-1] if vals else None)
        assert (r["s"] is None and not vals) or abs(r["s"] - sum(vals)) < 1e-6


def test_row_numbers_and_ntiles_without_key(events):
    rows, df = events
    rn = {r["id"]: r["rn"] for r in chunks.row_numbers(df, [], ["us", "id"]).collect()}
    order = sorted((t, i) for i, _, t, _ in rows)
    assert [rn[i] for _, i in order] == list(range(1, len(rows) + 1))
    tiles = {r["id"]: r["tile"] for r in chunks.ntiles(df, [], ["us", "id"], 7).collect()}
    q, rem = divmod(len(rows), 7)
    want = [j + 1 for j in range(7) for _ in range(q + (j < rem))]
    assert [tiles[i] for _, i in order] == want


def test_exact_quantiles(events, spark):
    import numpy as np

    rows, df = events
    got = {r["key"]: r for r in chunks.exact_quantiles(df, ["key"], "v", [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    for key in {k for _, k, _, _ in rows}:
        vals = [v for _, k, _, v in rows if k == key and v is not None]
        for name, p in (("q000", 0), ("q005", 5), ("q050", 50), ("q095", 95), ("q100", 100)):
            assert abs(got[key][name] - np.percentile(vals, p)) < 1e-9


@pytest.mark.parametrize("inclusive,ttl", [(True, None), (False, None), (True, 3600)])
def test_asof_equals_brute_force(events, spark, inclusive, ttl):
    rows, df = events
    spine = df.where("id % 2 = 0").select("id", "key", "ts")
    feats = df.where("id % 2 = 1").select("key", F.col("ts").alias("fts"), F.col("id").alias("fid"), "v")
    out = asof.asof_join(spine, feats, "key", "ts", "fts", ["fid", "v"], inclusive, ttl, ["fid"], n_chunks=5).collect()
    assert len(out) == len([r for r in rows if r[0] % 2 == 0])
    by_id = {r[0]: r for r in rows}
    for r in out:
        _, k, t, _ = by_id[r["id"]]
        cand = [(t2, i2, v2) for i2, k2, t2, v2 in rows if i2 % 2 and k2 == k and (t2 <= t if inclusive else t2 < t)]
        best = max(cand) if cand else None
        if best and ttl is not None and t - best[0] > ttl * MICRO:
            best = None
        assert r["fid"] == (best[1] if best else None)
        assert r["v"] == (best[2] if best else None)  # the value of the matched row, null or not


@pytest.mark.parametrize("bucket", [None, 3600])
def test_interval_join_equals_brute_force(events, bucket):
    rows, df = events
    left = df.where("id % 5 = 0").select(F.col("id").alias("l"), "key", "ts")
    right = df.select(F.col("id").alias("r"), "key", F.col("ts").alias("rts"))
    got = {(x["l"], x["r"]) for x in interval.interval_join(left, right, "key", "ts", "rts", 0, 7200, bucket).collect()}
    want = {(a[0], b[0]) for a in rows if a[0] % 5 == 0 for b in rows if a[1] == b[1] and 0 <= b[2] - a[2] <= 7200 * MICRO}
    assert got == want


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_results_do_not_depend_on_partitioning(events, spark, partitions):
    rows, df = events
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        shuffled = df.repartition(int(partitions))
        rn = chunks.row_numbers(shuffled, ["key"], ["us", "id"])
        assert rn.agg(F.sum(F.col("rn") * F.col("id"))).first()[0] == sum(
            i * (1 + sum((t2, i2) < (t, i) for i2, k2, t2, _ in rows if k2 == k)) for i, k, t, _ in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_null_keys_form_groups(spark):
    rows = [(None if k < 12 else "a", float(k % 7), k) for k in range(40)]
    df = spark.createDataFrame(rows, "k string, v double, t int")
    for n in (1, 16):
        got = {r["t"]: (r["s"], r["n"]) for r in chunks.running(df, ["k"], ["t"], {"s": ("sum", F.col("v")), "n": ("count", F.lit(1))}, n_chunks=n).collect()}
        for key, v, t in rows:
            before = [x for kk, x, tt in rows if kk == key and tt <= t]
            assert got[t] == (sum(before), len(before))
    events = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t") * 40_000))
    out = add_rolling(events, ["k"], "ts", [Rolling("n", "count", "v", 10 * 86400)], 86400)
    got = {r["t"]: r["n"] for r in out.collect()}
    assert all(got[t] == sum(1 for kk, _, tt in rows if kk == key and 0 < (t - tt) * 40_000 <= 10 * 86400) for key, _, t in rows)
