"""What large tables shuffle and keep on disk, counted on small ones."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskframe.functions.hashing import MIX_FACTOR, MIX_MODULUS
from riskframe.operators import chunks, labels, metrics, spine, splits
from riskframe.plans.registry import Tables
from riskframe.streaming import features as rs
from riskframe.streaming.run import file_stream, run_to_table

D = date(2020, 1, 1)


def shuffled_rows(df) -> int:
    """Rows that all shuffles of the plan wrote, once it has run."""
    df.collect()

    def of(plan) -> int:
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return of(plan.executedPlan())
        if name.endswith("QueryStage"):
            return of(plan.plan())
        written = plan.metrics().get("shuffleRecordsWritten")
        children = plan.children()
        return (written.get().value() if name == "Exchange" and written.isDefined() else 0) + sum(of(children.apply(i)) for i in range(children.size()))

    written = of(df._jdf.queryExecution().executedPlan())
    assert written > 0, "the plan has no shuffle that was counted"
    return written


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """60 customers, 240 orders over seven years."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, f"C{i}", i % 25, float(i % 9 - 1), "ABC"[i % 3]) for i in range(60)],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    orders = [(i, i % 60, "FOP"[i * 7 % 3], float(i), datetime(1995, 1, 1) + timedelta(i * 53 % 2400 if i >= 60 else i % 50), "5-LOW") for i in range(240)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return Tables(spark, folder)


# ---- spines --------------------------------------------------------------------------------

def test_first_reports_of_members_equal_the_joined_spine(spark):
    m = spark.createDataFrame([("a", 1, D - timedelta(9), 0, None), ("a", 1, D - timedelta(400), 1, D - timedelta(300)), ("b", 1, D, 1, D + timedelta(40)),
                               ("b", 1, D, 1, D + timedelta(40)), ("c", 0, D, 0, None), ("d", 1, D, None, None), ("e", 1, None, 0, None), (None, 1, D, 0, None),
                               ("f", 1, D - timedelta(1), 0, None)], "company_id string, is_approved int, approved_at date, is_rejected int, rejected_at date")
    r = spark.createDataFrame([("a", D + timedelta(d)) for d in (-380, -1, 0, 90, 91, 200, 200)] + [("b", D + timedelta(120)), ("f", D + timedelta(91)), ("f", None),
                               (None, D + timedelta(3)), ("x", D)], "company_id string, reported_at date")
    cal = spark.createDataFrame([(k, D + timedelta(d)) for k, d in (("m", -395), ("m", -30), ("m", 0), ("m", 1), ("m", 1), ("n", 0), ("n", 31), ("n", 110), ("n", 500))], "mode string, feature_date date")
    got = labels.member_first_reports(cal, m, r)
    want = labels.first_report_after(spine.member_spine(cal, m), r)
    key = lambda row: str(tuple(row))
    assert got.columns == want.columns and sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and got.count() > 15
    split = labels.member_first_reports(cal, m, r, by=["mode"])
    parts = [labels.first_report_after(spine.member_spine(cal.where(F.col("mode") == k), m), r).select("company_id", F.lit(k).alias("mode"), "timestamp", "first_report_at") for k in "mn"]
    assert sorted(split.collect(), key=key) == sorted(parts[0].union(parts[1]).collect(), key=key)


def test_targets_do_not_shuffle_the_spine(tables):
    from riskframe.plans.q_relational import _targets

    df = _targets(tables)
    assert shuffled_rows(df) < 1000 < 3000 < df.count()  # over twice the spine before


def test_spine_modes_are_compared_by_counts(spark, tables):
    from riskframe.plans import q_labels

    out = q_labels.lb10(tables)
    assert shuffled_rows(out) < 1000 < 6000 < out.agg(F.sum("n")).first()[0]  # the spine itself before
    assert out.columns == ["mode", "n", "companies", "event_rate", "mean_days", "median_days"]
    months = 79  # each mode by itself, from its joined spine
    for r in out.collect():
        s = spine.member_spine(q_labels._calendar(tables, r["mode"], seed=7), q_labels.v.members(tables))
        d = labels.first_report_after(s, q_labels.v.reports(tables)).select("company_id", F.datediff("first_report_at", "timestamp").alias("days")).collect()
        hits = sorted(x["days"] for x in d if x["days"] is not None)
        assert len(d) < months * 60 and (r["n"], r["companies"]) == (len(d), len({x["company_id"] for x in d}))
        assert abs(r["event_rate"] - len(hits) / len(d)) < 1e-6 and abs(r["mean_days"] - sum(hits) / len(hits)) < 1e-4
        assert r["median_days"] == (hits[(len(hits) - 1) // 2] + hits[len(hits) // 2]) / 2


def test_quantiles_of_counted_values(spark):
    rows = [("ab"[i % 2], float(i * 7 % 11) if i % 5 else None, 1 + i % 4) for i in range(40)]
    one = spark.createDataFrame(rows, "k string, x double, n int")
    many = one.withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    got = [sorted(chunks.exact_quantiles(df, ["k"], "x", [0.1, 0.5, 0.9], weight=w).collect()) for df, w in ((one, "n"), (many, None))]
    assert got[0] == got[1] and len(got[0]) == 2


# ---- folds ---------------------------------------------------------------------------------

def test_repeated_folds_rank_rows_once(spark):
    last = pow(MIX_FACTOR, -1, MIX_MODULUS) * (MIX_MODULUS - 1) % MIX_MODULUS  # its mix is the largest, and of its twice the second largest
    ids = [*range(300), *(last * i % MIX_MODULUS + MIX_MODULUS * j for i in (1, 2, 3) for j in range(5))]
    rows = [(i, None if i % 7 == 0 else i % 3) for i in ids]
    out = splits.repeated_folds(spark.createDataFrame(rows, "id long, y int"), ["y"], "id", 3, 4, n_chunks=4)
    assert shuffled_rows(out) < 2 * len(rows)  # four times before
    assert out.columns == ["id", "y", "repeat", "fold"]
    got = {(r["repeat"], r["id"]): r["fold"] for r in out.collect()}
    for rep in range(4):
        for y in (None, 0, 1, 2):
            order = sorted((i for i, k in rows if k == y), key=lambda i: ((i % MIX_MODULUS * MIX_FACTOR + rep) % MIX_MODULUS, i))
            assert [got.pop((rep, i)) for i in order] == [n % 3 for n in range(len(order))]
    assert not got


def test_counted_rows_weigh_as_their_copies(spark):
    rows = [(i % 2, i % 3, i * 5 % 4, int(i % 5 == 0), 1 + i * 7 % 6, 1 + i % 4) for i in range(90)]
    one = spark.createDataFrame(rows, "repeat int, fold int, g int, y int, d int, n int")
    many = one.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).drop("copy")
    a, b = splits.out_of_fold_rate(one, "g", "y", weight="n"), splits.out_of_fold_rate(many, "g", "y")
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    scores = [metrics.concordance(x, "d", "y", "risk", keys=("repeat", "fold"), weight=w).collect() for x, w in ((a, "n"), (b, None))]
    assert sorted(scores[0]) == sorted(scores[1]) and len(scores[0]) == 6


def test_folds_are_counted_before_they_are_scored(tables, monkeypatch):
    """The baseline model and the concordance of ``mt3_repeated_folds`` read counts, not the rows of the spine."""
    from riskframe.plans import q_learning

    read, whole = [], metrics.concordance
    monkeypatch.setattr(metrics, "concordance", lambda df, *a, **b: read.append(shuffled_rows(df)) or whole(df, *a, **b))
    assert q_learning.mt3_folds(tables).collect()[0]["n"] == 6
    assert read[0] < 3000


# ---- sliding windows -----------------------------------------------------------------------

PAYMENTS = "event_id long, ts timestamp, account_id long, deposit double, withdrawal double"
T0 = datetime(2024, 1, 1)


def windows_of(batches, delay=60):
    """Windows of two hours every ten minutes, closed by the watermark; a row counts if its ten minutes were open when its batch was read."""
    mark, sums = None, {}
    for rows in batches:
        for _, ts, account, dep, wd in rows:
            slot = None if ts is None else (ts - T0) // timedelta(minutes=10)
            if ts is not None and (mark is None or T0 + timedelta(minutes=10) * (slot + 1) > mark):
                for first in range(slot - 11, slot + 1):
                    sums.setdefault((account, T0 + timedelta(minutes=10) * first), []).append((dep, wd))
        seen = [r[1] for r in rows if r[1] is not None]
        mark = max([x for x in (mark, max(seen) - timedelta(minutes=delay) if seen else None) if x is not None])
    add = lambda x: round(sum(x), 6) if x else None
    out = {}
    for (account, start), v in sums.items():
        dep, wd = [d for d, _ in v if d is not None], [w for _, w in v if w is not None]
        if start + timedelta(hours=2) <= mark:
            out[account, start, start + timedelta(hours=2)] = (add(dep), add(wd), len(dep), len(wd))
    return out


def payment_rows(n):
    out = []
    for i in range(n):
        at = T0 + timedelta(minutes=(i * 37 % 60 - 30) + 5 * i, seconds=i)
        out.append((i, None if i % 41 == 40 else at, None if i % 13 == 0 else i % 4, float(i % 9) if i % 3 else None, None if i % 2 else i / 4))
    return out + [(n, T0 + timedelta(minutes=600), 9, 1.0, None), (n + 1, T0 + timedelta(minutes=600), 9, 1.0, None)]


@pytest.mark.parametrize("cuts", [[0, 400], [0, 100, 250, 400], [0, 399, 400]])
def test_sliding_sums_equal_brute_force(spark, tmp_path, cuts):
    data = payment_rows(240)
    data = [*data[:50], *data[150:], *data[50:150]]  # a hundred rows come far too late, if not in the first batch
    batches = [data[a:b] for a, b in zip(cuts, cuts[1:]) if data[a:b]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, PAYMENTS).coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
    stream = file_stream(spark, str(tmp_path / "in/*"), spark.createDataFrame([], PAYMENTS).schema, files_per_batch=1)
    slots, _ = run_to_table(stream, "s", "append", rs.slot_sums, str(tmp_path / "run"))
    got = [tuple(r) for r in rs.sliding_sums(slots).collect()]
    want = windows_of(batches)
    key = lambda r: r[:3]
    assert len(got) == len({key(r) for r in got})
    assert {key(r): (*[None if x is None else round(x, 6) for x in r[3:5]], *r[5:]) for r in got} == want and len(want) > 300
    with pytest.raises(ValueError):
        rs.sliding_sums(slots, window="25 minutes")


def test_one_batch_gives_the_windows_of_the_engine(spark, tmp_path):
    spark.createDataFrame(payment_rows(240), PAYMENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], PAYMENTS).schema)
    engine, _ = run_to_table(rs.windowed_sums(stream), "w", folder=str(tmp_path / "w"))
    slots, _ = run_to_table(stream, "s", "append", rs.slot_sums, str(tmp_path / "s"))
    own = rs.sliding_sums(slots)
    plain = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert own.dtypes == engine.dtypes and plain(own) == plain(engine)


def test_windows_are_not_kept_for_each_event(spark, tmp_path, monkeypatch):
    """``rs1_windowed_sums`` writes and shuffles a row for each event at most, not one for each of its twelve windows."""
    from riskframe.plans import q_streaming

    events = [(i, T0 + timedelta(minutes=25 * i), i % 40, "click" if i % 2 else "view", 1.0, '{"k": 1}') for i in range(400)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    kept = []
    monkeypatch.setattr(q_streaming, "run_to_table", lambda stream, name, *a, **b: kept.append(x := run_to_table(stream, name, *a, folder=str(tmp_path / "run"), **b)) or x)
    out = q_streaming.rs1(Tables(spark, str(tmp_path)))
    assert out.count() > 4000
    assert kept[0][0].count() <= 400  # over 4,000 before
    assert not list(tmp_path.glob("run/log/state/*"))
    assert shuffled_rows(out) < 500
