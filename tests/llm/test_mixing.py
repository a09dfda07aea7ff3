"""Mixing: targets by brute force, trades against a Python fold, odd inputs."""

import math
import random

from pyspark.sql import functions as F

from riskframe.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        got = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest} if rest else {}
        above = [s for s in rest if got[s] > cap * sizes[s]]
        if not above:
            return fixed | got
        fixed |= {s: cap * sizes[s] for s in above}


def sample(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "b", "Z", "é", None, "hot", "hot", "hot"])
        rows.append((i, source, " ".join(["w"] * rng.choice([0, 1, 2, 5, 9, 30, 200]))))
    return rows


def test_targets_and_words(spark):
    rows = sample()
    got = mixing.report(mixing.decide(frame(spark, rows), fan_in=8)).collect()
    assert len(got) == len(rows)
    sizes, longest, taken = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        longest[r.source] = max(longest.get(r.source, 0), r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r.size and r.taken in (r.size * math.floor(r.target / r.source_size), r.size * math.ceil(r.target / r.source_size))
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) < longest[s]


def test_reruns_and_partitions_agree(spark):
    rows = sample(200, 5)
    one = sorted(map(tuple, mixing.report(mixing.decide(frame(spark, rows).repartition(1))).fillna("-").collect()))
    two = sorted(map(tuple, mixing.report(mixing.decide(frame(spark, rows[::-1]).repartition(7))).fillna("-").collect()))
    assert one == two


def python_chain(items):
    held, done = None, {}
    for x in items:
        if held is None:
            held = dict(x)
            continue
        (p, s), (q, t) = (held["p"], held["s"]), (x["p"], x["s"])
        up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        if x["u"] * (up + down) < down:
            p, q = (1.0, q - (1 - p) * s / t) if (1 - p) * s <= q * t else (p + q * t / s, 0.0)
        else:
            p, q = (0.0, q + p * s / t) if p * s <= (1 - q) * t else (p - (1 - q) * t / s, 1.0)
        rest = None
        for i, v, w in ((held["i"], p, s), (x["i"], q, t)):
            if v < 1e-9 or v > 1 - 1e-9:
                done[i] = round(v)
            elif rest is None:
                rest = {"i": i, "p": v, "s": w, "u": 0.0}
        held = rest
    return held, done


def test_trades_equal_a_plain_fold(spark):
    rng = random.Random(1)
    for n in (1, 2, 3, 17, 60):
        items = [{"i": i, "p": rng.uniform(0.05, 0.95), "s": float(rng.randint(1, 50)), "u": rng.random()} for i in range(n)]
        df = spark.createDataFrame([(items,)], "items array<struct<i:int,p:double,s:double,u:double>>")
        out = df.select(mixing._chain(F.col("items")).alias("x")).first()["x"]
        held, done = python_chain(items)
        assert {d["i"]: d["up"] for d in out["done"]} == done
        assert (out["held"] is None) == (held is None)
        before = sum(x["p"] * x["s"] for x in items)
        after = sum(items[i]["s"] * v for i, v in done.items()) + (held["p"] * held["s"] if held else 0)
        assert abs(before - after) < 1e-6


def test_expected_copies_are_kept(spark):
    n = 600
    rows = [(i, "abc"[i % 3], "w " * (1 + i % 7)) for i in range(n)]
    taken = [0.0, 0]
    for seed in range(4):
        for r in mixing.report(mixing.decide(frame(spark, rows), seed=seed)).where("source = 'b'").collect():
            taken[0] += r.target / r.source_size
            taken[1] += r.copies
    assert abs(taken[1] - taken[0]) < 0.08 * taken[0]


def test_repeated_rows_nulls_and_empty_texts(spark):
    rows = [(None, "a", "x y z")] * 50 + [(1, "a", "one two"), (1, "a", "other words"), (2, None, None), (3, "b", ""), (4, "b", "solo")]
    got = mixing.report(mixing.decide(frame(spark, rows), fan_in=4))
    assert got.count() == len(rows)
    by = {r["source"]: r for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()}
    assert abs(by["a"]["t"] - by["a"]["target"]) <= 3 and by[None]["t"] == 0
    mixed = mixing.mix(frame(spark, rows), fan_in=4)
    assert mixed.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == got.agg(F.sum("taken")).first()[0]


def test_empty_table_and_clashing_columns(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.report(mixing.decide(frame(spark, []))).count() == 0
    names = ["size", "key", "number", "m", "base", "extra", "bucket", "key_id"]
    docs = frame(spark, sample(40)).select("*", *[F.lit(n).alias(n) for n in names])
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copy"] and {r[0] for r in mixed.select("m").distinct().collect()} == {"m"}
