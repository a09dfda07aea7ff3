"""Streams fed file by file give the batch results; late rows and duplicates are handled."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators.rolling import Rolling, add_rolling
from riskframe.streaming import features as rs
from riskframe.streaming.run import file_stream, run_to_table
from riskframe.streaming.state import NewPayees, RollingState

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, account_id long, counterparty int, deposit double, withdrawal double"


def rows(n=240):
    out = []
    for i in range(n):
        amount = round(1 + (i * 37) % 101 / 7, 3)
        account = 1 if i % 3 else 2 + i % 4
        out.append((i, T0 + timedelta(minutes=11 * i), account, i * 7 % 9, amount if i % 2 else None, None if i % 2 else amount))
    return out


@pytest.fixture()
def feed(spark, tmp_path):
    """Four files in time order, as a stream of one file per micro-batch."""
    data = rows()
    for part in range(4):
        df = spark.createDataFrame(data[part * 60:(part + 1) * 60], SCHEMA).coalesce(1)
        df.write.parquet(str(tmp_path / f"in/p={part}"))
        # the source reads by modification time; folders are written in order
    batch = spark.createDataFrame(data, SCHEMA)
    stream = file_stream(spark, str(tmp_path / "in/*"), batch.schema, files_per_batch=1)
    return batch, stream, str(tmp_path / "run")


@pytest.mark.parametrize("shards", [1, 3])
def test_rolling_state_equals_batch(feed, shards):
    batch, stream, folder = feed
    out, _ = run_to_table(rs.rolling_state(stream, (2, 48), shards=shards), "r", "append", rs.merge_shards, folder)
    ms = [Rolling(f"{s}_{m}_{k}", a, c, sec) for k, sec in (("2h", 7200), ("48h", 172800), ("60d", 60 * 86400))
          for s, c in (("dep", "deposit"), ("wd", "withdrawal")) for m, a in (("sum", "sum"), ("n", "count"), ("max", "max"))]
    want = {r["event_id"]: r for r in add_rolling(batch, ["account_id"], "ts", ms, 7200).collect()}
    got = {r["event_id"]: r for r in out.collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        for m in ms:
            a, b = got[i][m.name], w[m.name]
            if m.agg == "sum":
                assert abs(a - (b or 0.0)) < 1e-9
            else:
                assert a == b, (i, m.name, a, b)


def test_windows_equal_batch_once_closed(feed):
    batch, stream, folder = feed
    out, _ = run_to_table(rs.windowed_sums(stream, watermark="1 hour", window="2 hours", slide=None), "w", folder=folder)
    closed = T0 + timedelta(minutes=11 * 239) - timedelta(hours=1)
    want = (batch.groupBy(F.window("ts", "2 hours").alias("w"), "account_id").agg(F.sum("deposit").alias("d"), F.count("withdrawal").alias("n"))
            .where(F.col("w.end") <= F.lit(closed)))
    key = lambda d, *c: {(r[0], r[1]): tuple(r[2:]) for r in d.select("account_id", *c).collect()}
    got, want = key(out, "window_start", "deposits_sum", "outgoing_payments"), key(want, "w.start", "d", "n")
    assert set(got) == set(want)
    for k in want:
        assert got[k][1] == want[k][1] and (got[k][0] is None) == (want[k][0] is None)
        assert want[k][0] is None or abs(got[k][0] - want[k][0]) < 1e-9


def test_first_payments_are_upserts(feed):
    batch, stream, folder = feed
    out, _ = run_to_table(rs.first_payments(stream), "f", "update", lambda b: b, folder)
    got = {(r[0], r[1]): r[2] for r in out.groupBy("account_id", "counterparty").agg(F.min("first_at")).collect()}
    want = {(r[0], r[1]): r[2] for r in batch.groupBy("account_id", "counterparty").agg(F.min("ts")).collect()}
    assert got == want


def test_duplicates_and_late_rows(spark, tmp_path):
    first = [(1, T0, 5.0), (1, T0, 5.0), (2, T0 + timedelta(hours=5), 6.0)]
    second = [(2, T0 + timedelta(hours=5), 6.0), (3, T0 + timedelta(minutes=1), 7.0), (4, T0 + timedelta(hours=5, minutes=-30), 8.0)]
    between = [(5, T0 + timedelta(hours=5, minutes=1), 9.0)]  # lateness is judged by the previous batch's watermark
    for n, part in enumerate((first, between, second)):
        spark.createDataFrame(part, "event_id long, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / f"in/p={n}"))
    stream = file_stream(spark, str(tmp_path / "in/*"), spark.createDataFrame(first, "event_id long, ts timestamp, v double").schema, 1)
    out, query = run_to_table(rs.deduplicated(stream), "d", folder=str(tmp_path / "run"))
    # 3 is past the watermark (dropped and counted); 4 is out of order but inside it
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 4, 5]
    assert rs.late_rows(query) == 1


class Memory:
    """A stand-in for the state store that counts what is read and put."""

    def __init__(self):
        self.data, self.reads, self.puts = {}, 0, 0

    def getValue(self, key):
        self.reads += 1
        return self.data[key]

    def containsKey(self, key):
        return key in self.data

    def updateValue(self, key, value):
        self.puts += 1
        self.data[key] = value

    def removeKey(self, key):
        self.data.pop(key, None)

    def iterator(self):
        return iter(list(self.data.items()))

    def keys(self):
        return iter(list(self.data))


class One:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Memory())

    def getValueState(self, name, *_):
        return self.maps.setdefault(name, One())

    def registerTimer(self, ms):
        self.timers.append(ms)


class Clock:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
SPANS = {"2h": 2 * HOUR_US, "48h": 48 * HOUR_US, "60d": 60 * DAY_US}


def _batch(times, start=0):
    return pd.DataFrame({"event_id": np.arange(start, start + len(times)), "us": times, "home": 0, "deposit": np.where(np.arange(len(times)) % 2, 1.5, np.nan),
                         "withdrawal": np.where(np.arange(len(times)) % 2, np.nan, 2.0)})


@pytest.mark.parametrize("small", [0, 100, 2000, 10**6])
def test_a_batch_costs_its_rows_not_the_history(small):
    handle, reads = Handle(), []
    processor = RollingState(SPANS, 60 * DAY_US + HOUR_US, 2 * HOUR_US, "event_id", "account_id", small)
    processor.init(handle)
    rng = np.random.default_rng(1)
    every = []
    for day in range(130):
        times = np.sort(rng.integers(day * DAY_US, (day + 1) * DAY_US, 40))
        every.append(_batch(times, 40 * day))
        before = (handle.maps["rows"].reads, handle.maps["rows"].puts)
        (out,) = processor.handleInputRows((7, 0), iter([every[-1]]), Clock(max(0, day * DAY_US - HOUR_US)))
        reads.append((handle.maps["rows"].reads - before[0], handle.maps["rows"].puts - before[1]))
        past = pd.concat(every)
        t, d = past["us"].to_numpy(), past["deposit"].to_numpy()
        for k, us in enumerate(times):
            for name, span in SPANS.items():
                inside = d[(t >= us - span) & (t < us) & ~np.isnan(d)]
                assert abs(out[f"dep_sum_{name}"].iloc[k] - inside.sum()) < 1e-9 and out[f"dep_n_{name}"].iloc[k] == len(inside)
                assert np.isnan(out[f"dep_max_{name}"].iloc[k]) if not len(inside) else out[f"dep_max_{name}"].iloc[k] == inside.max()
    # a day's rows touch at most its 12 buckets and the 12 at the edge of each window, however long the history is
    assert max(r for r, _ in reads) <= 5 * 13 and max(p for _, p in reads[-60:]) <= 12
    assert (len(handle.maps["few"].value[1]) > 0) == (small == 10**6) and len(handle.maps["few"].value[1]) <= 63 * 40 * 8
    assert len(handle.maps["days"].data) <= 63 and len(handle.maps["rows"].data) <= 63 * 12
    assert handle.timers[-1] * 1000 > every[-1]["us"].max() + 60 * DAY_US
    list(processor.handleExpiredTimer((7, 0), Clock(int(every[-1]["us"].max()) + 60 * DAY_US + HOUR_US), None))
    assert len(handle.maps["days"].data) <= 1
    list(processor.handleExpiredTimer((7, 0), Clock(int(every[-1]["us"].max()) + 62 * DAY_US), None))
    assert not handle.maps["days"].data and not handle.maps["rows"].data and not handle.maps["few"].exists()


@pytest.mark.parametrize("small", [0, 2000])
def test_late_rows_find_their_window_and_count_later(small):
    processor, handle = RollingState(SPANS, 60 * DAY_US + HOUR_US, 2 * HOUR_US, "event_id", "account_id", small), Handle()
    processor.init(handle)
    t = [DAY_US, DAY_US + HOUR_US, DAY_US + 3 * HOUR_US]
    list(processor.handleInputRows((1, 0), iter([_batch(np.array([t[0], t[2]]))]), Clock(0)))
    late = _batch(np.array([t[1]]), 2)
    (out,) = processor.handleInputRows((1, 0), iter([late]), Clock(t[0]))
    assert out["wd_n_2h"].tolist() == [1] and out["wd_sum_48h"].tolist() == [2.0] and out["dep_n_60d"].tolist() == [0]
    (out,) = processor.handleInputRows((1, 0), iter([_batch(np.array([t[2] + 1]), 3)]), Clock(t[0]))
    assert out["wd_n_48h"].tolist() == [2] and out["dep_n_2h"].tolist() == [1] and out["dep_n_48h"].tolist() == [1]


@pytest.mark.parametrize("shards", [1, 3])
def test_new_payee_counts_equal_batch(feed, shards):
    batch, stream, folder = feed
    spans = {"n_2h": 7200, "n_48h": 172800}
    out, _ = run_to_table(rs.new_payee_state(stream, spans, shards=shards), "n", "append", rs.merge_counts, folder)
    firsts = batch.groupBy("account_id", "counterparty").agg(F.min(F.struct("ts", "event_id")).alias("f")).select(F.col("f.event_id").alias("first_id"))
    want = {r["event_id"]: (r["n_2h"], r["n_48h"]) for r in rs.new_payee_counts(batch, firsts, spans).collect()}
    assert {r["event_id"]: (r["n_2h"], r["n_48h"]) for r in out.collect()} == want


def test_known_pairs_are_never_new(feed):
    batch, stream, folder = feed
    known = batch.where("event_id < 60").select("account_id", "counterparty")
    out, _ = run_to_table(rs.new_payee_state(stream, {"n_48h": 172800}, known, shards=2), "k", "append", rs.merge_counts, folder)
    pairs = {(r["account_id"], r["counterparty"]) for r in known.collect()}
    firsts = {}
    for i, ts, account, payee, *_ in rows():
        if (account, payee) not in pairs:
            firsts.setdefault((account, payee), ts)
    want = {i: sum(a == account and ts - timedelta(hours=48) <= f < ts for (a, _), f in firsts.items()) for i, ts, account, *_ in rows()}
    assert {r["event_id"]: r["n_48h"] for r in out.collect()} == want


@pytest.mark.parametrize("small", [0, 1, 2000])
def test_new_payees_are_forgotten(small):
    processor, handle = NewPayees({"n": 48 * HOUR_US}, 60 * DAY_US, "event_id", "account_id", small), Handle()
    processor.init(handle)

    def feed(t, payee, row, mark):
        d = pd.DataFrame({"event_id": [row], "us": [t], "home": [0], "payee": [payee], "known": [False]})
        return next(processor.handleInputRows((1, 0), iter([d]), Clock(mark)))["n"].iloc[0]

    def held():
        few = handle.maps["few"].value
        return sorted({p for (p,) in handle.maps["firsts"].data} | set(few[1] if few else ()))

    assert feed(DAY_US, "a", 1, 0) == 0 and feed(DAY_US + 5, "b", 2, 0) == 1 and feed(DAY_US + 9, "a", 3, 0) == 2
    assert feed(DAY_US - HOUR_US, "b", 4, 0) == 0  # late: b was paid before
    assert feed(DAY_US, "a", 5, 0) == 1 and held() == ["a", "b"]
    list(processor.handleExpiredTimer((1, 0), Clock(61 * DAY_US), None))
    assert held() == ["a"]
    list(processor.handleExpiredTimer((1, 0), Clock(63 * DAY_US), None))
    assert held() == [] and not handle.maps["recent"].data and not handle.maps["few"].exists()
