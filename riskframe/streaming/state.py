"""Keyed state of streams: exact rolling windows and new payees, by the state processor API.

A key with at most ``SMALL`` rows is one value. Beyond that its state lies in maps of the state store and is
read where a batch needs it: a batch costs its rows, the buckets at the edges of their windows and the
partial sums of the days between, never a key's history.
Event-time timers forget what no window can reach any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
#: partials of a bucket: rows, then sum, count and maximum of each measure
ROWS, WIDTH = 0, 7
SMALL = 2000  # rows of a key that are kept as one value, 24 bytes each


def _column(block: bytes) -> np.ndarray:
    return np.frombuffer(bytes(block), np.float64)


def between(times: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum, count and maximum of the known ``values`` stamped in [low, high) for each pair (times sorted); no maximum is -inf."""
    lo, hi = np.searchsorted(times, low, "left"), np.searchsorted(times, high, "left")
    known = ~np.isnan(values)
    # extended precision keeps differences of running sums clean
    total = np.concatenate([[0], np.cumsum(np.where(known, values, 0).astype(np.longdouble))])
    count = np.concatenate([[0], np.cumsum(known)])
    return (total[hi] - total[lo]).astype(float), count[hi] - count[lo], _top(np.where(known, values, -np.inf), lo, hi)


def _top(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    if not len(lo):
        return np.array([])
    edges = np.column_stack([lo, np.maximum(lo, hi)]).ravel()
    return np.where(hi > lo, np.maximum.reduceat(np.append(values, -np.inf), edges)[::2], -np.inf)


class RollingState(StatefulProcessor):
    """Exact sums, counts and maxima of deposits and withdrawals in windows before each row.

    ``few`` holds the rows of a small key, and whether it has become a large one. Maps of a large one: ``rows``,
    bucket to its raw rows; ``days``, day to the partials of its buckets. A window is the
    rest of the bucket it begins in, whole buckets, and the bucket of the row up to it. Only these two
    edge buckets are read as rows. Windows are multiples of the bucket, which divides the day.
    """

    def __init__(self, spans: dict[str, int], keep_us: int, bucket_us: int, row_id: str, account: str, small: int = SMALL):
        if DAY_US % bucket_us or any(s % bucket_us for s in spans.values()):
            raise ValueError("windows must be multiples of the bucket, and the bucket must divide the day")
        self.spans, self.keep, self.bucket, self.row_id, self.account = spans, keep_us, bucket_us, row_id, account
        self.per_day, self.small = DAY_US // bucket_us, small

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "bucket long", "t binary, d binary, w binary")
        self.days = handle.getMapState("days", "day long", "parts binary")
        self.few = handle.getValueState("few", "large boolean, t binary, d binary, w binary")

    def _partials(self) -> dict[int, np.ndarray]:
        return {int(k[0]): _column(v[0]).reshape(self.per_day, WIDTH).copy() for k, v in self.days.iterator()}

    def _raw(self, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, d, w = self.rows.getValue((bucket,))
        return np.frombuffer(bytes(t), np.int64), _column(d), _column(w)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["us", self.row_id], kind="stable")
        at = new["us"].to_numpy(dtype=np.int64)
        mine = new[new["home"] == key[1]]
        t = mine["us"].to_numpy(dtype=np.int64)
        flows = [mine[c].to_numpy(dtype=float) for c in ("deposit", "withdrawal")]
        large, old = self._held()
        before = timerValues.getCurrentWatermarkInMs() * 1000 - self.keep
        out = {self.account: key[0], self.row_id: new[self.row_id].to_numpy(), "shard": key[1]}
        days = self._partials() if large else {}
        if len(old[0]):
            alive = old[0] >= before
            t, flows = np.concatenate([old[0][alive], t]), [np.concatenate([a[alive], c]) for a, c in zip(old[1:], flows)]
            order = np.argsort(t, kind="stable")
            t, flows = t[order], [c[order] for c in flows]
        stats = {}
        for name, span in self.spans.items():
            for k, short in enumerate(("dep", "wd")):
                stats[short, name] = list(between(t, flows[k], at - span, at))
        if days:
            self._add_old(at, days, stats)
        for (short, name), (total, count, top) in stats.items():
            out[f"{short}_sum_{name}"], out[f"{short}_n_{name}"] = total, count
            out[f"{short}_max_{name}"] = np.where(np.isfinite(top), top, np.nan)
        if not large and len(t) <= self.small:
            self.few.update((False, t.tobytes(), flows[0].tobytes(), flows[1].tobytes()))
        else:
            self._store(t, flows, days)
            self._forget(days, before)
            if not large:
                self.few.update((True, b"", b"", b""))
        if len(t):
            self.handle.registerTimer(int((int(at.max()) + self.keep) // 1000) + 1)
        yield pd.DataFrame(out)

    def _held(self) -> tuple[bool, list[np.ndarray]]:
        """Whether the key is large, and the rows of a small one."""
        if not self.few.exists():
            return False, [np.empty(0, np.int64), np.empty(0), np.empty(0)]
        large, t, d, w = self.few.get()
        return large, [np.frombuffer(bytes(t), np.int64), _column(d), _column(w)]

    def _add_old(self, at: np.ndarray, days: dict[int, np.ndarray], stats: dict) -> None:
        """Add what earlier batches left in the windows before ``at``."""
        b, first = self.bucket, min(days) * self.per_day
        cells = np.zeros(((max(days) - min(days) + 1) * self.per_day, WIDTH))
        cells[:, [3, 6]] = -np.inf
        for day, parts in days.items():
            cells[day * self.per_day - first : (day + 1) * self.per_day - first] = parts
        own = at // b
        edges = np.unique(np.concatenate([own, *[(at - s) // b for s in self.spans.values()]]))
        edges = edges[(edges >= first) & (edges < first + len(cells))]
        raw = [self._raw(int(e)) for e in edges if cells[e - first, ROWS]]
        times = np.concatenate([r[0] for r in raw]) if raw else np.empty(0, np.int64)
        total = np.concatenate([np.zeros((1, 4)), np.cumsum(cells[:, [1, 2, 4, 5]].astype(np.longdouble), 0)])
        for name, span in self.spans.items():
            begin = (at - span) // b
            lo, hi = np.clip(begin + 1 - first, 0, len(cells)), np.clip(own - first, 0, len(cells))
            for k, short in enumerate(("dep", "wd")):
                values = np.concatenate([r[1 + k] for r in raw]) if raw else np.empty(0)
                mine = stats[short, name]
                pieces = [between(times, values, at - span, (begin + 1) * b), between(times, values, own * b, at)]
                pieces.append(((total[hi, 2 * k] - total[lo, 2 * k]).astype(float), (total[hi, 2 * k + 1] - total[lo, 2 * k + 1]).astype(np.int64), _top(cells[:, 3 * k + 3], lo, hi)))
                for p in pieces:
                    mine[0], mine[1], mine[2] = mine[0] + p[0], mine[1] + p[1], np.maximum(mine[2], p[2])

    def _store(self, t: np.ndarray, flows: list[np.ndarray], days: dict[int, np.ndarray]) -> None:
        """Put the new rows into their buckets and the partials of their days."""
        if not len(t):
            return
        buckets = t // self.bucket
        starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        for lo, hi in zip(starts, [*starts[1:], len(t)]):
            bucket = int(buckets[lo])
            day, place = divmod(bucket, self.per_day)
            if day not in days:
                days[day] = np.zeros((self.per_day, WIDTH))
                days[day][:, [3, 6]] = -np.inf
            cell, block = days[day][place], [t[lo:hi], flows[0][lo:hi], flows[1][lo:hi]]
            if cell[ROWS]:
                block = [np.concatenate([a, c]) for a, c in zip(self._raw(bucket), block)]
                order = np.argsort(block[0], kind="stable")
                block = [c[order] for c in block]
            self.rows.updateValue((bucket,), tuple(c.tobytes() for c in block))
            cell[ROWS] += hi - lo
            for k in range(2):
                v = flows[k][lo:hi]
                v = v[~np.isnan(v)]
                cell[3 * k + 1] += v.sum()
                cell[3 * k + 2] += len(v)
                cell[3 * k + 3] = max(cell[3 * k + 3], v.max() if len(v) else -np.inf)
        for day in sorted({int(b) // self.per_day for b in buckets[starts]}):
            self.days.updateValue((day,), (days[day].tobytes(),))

    def _forget(self, days: dict[int, np.ndarray], before: int) -> None:
        """Remove whole days that end at or before ``before``."""
        for day in [d for d in days if (d + 1) * DAY_US <= before]:
            for place in np.flatnonzero(days[day][:, ROWS]):
                self.rows.removeKey((int(day * self.per_day + place),))
            self.days.removeKey((day,))
            del days[day]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = timerValues.getCurrentWatermarkInMs() * 1000 - self.keep
        large, old = self._held()
        if large:
            days = self._partials()
            self._forget(days, before)
            if not days:
                self.few.clear()
        elif len(old[0]):
            alive = old[0] >= before
            if alive.any():
                self.few.update((False, *[c[alive].tobytes() for c in old]))
            else:
                self.few.clear()
        yield from ()

    def close(self) -> None:
        pass


class NewPayees(StatefulProcessor):
    """Per row, how many payees the account paid for the first time in the spans before it.

    ``few`` holds the pairs of a small key, and whether it has become a large one. Maps of a large one:
    ``firsts``, payee to the time and id of its first payment; ``recent``, hour to the first
    payments in it. Only the payees of the batch and the hours of its spans are read. A pair that ``known``
    says is older is never new. Pairs are forgotten ``keep_us`` after their first payment.
    """

    def __init__(self, spans: dict[str, int], keep_us: int, row_id: str, account: str, small: int = SMALL):
        self.spans, self.keep, self.row_id, self.account, self.small = spans, keep_us, row_id, account, small

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.firsts = handle.getMapState("firsts", "payee string", "us long, id long")
        self.recent = handle.getMapState("recent", "hour long", "us binary, payees array<string>")
        self.few = handle.getValueState("few", "large boolean, payees array<string>, us binary, id binary")

    def _hour(self, hour: int) -> dict[str, int]:
        if not self.recent.containsKey((hour,)):
            return {}
        us, payees = self.recent.getValue((hour,))
        return dict(zip(payees, np.frombuffer(bytes(us), np.int64).tolist()))

    def _put(self, hour: int, pairs: dict[str, int]) -> None:
        if pairs:
            self.recent.updateValue((hour,), (np.array(list(pairs.values()), np.int64).tobytes(), list(pairs)))
        else:
            self.recent.removeKey((hour,))

    def _held(self) -> tuple[bool, dict[str, tuple[int, int]]]:
        """Whether the key is large, and the pairs of a small one."""
        if not self.few.exists():
            return False, {}
        large, payees, us, ids = self.few.get()
        return large, dict(zip(payees, zip(np.frombuffer(bytes(us), np.int64).tolist(), np.frombuffer(bytes(ids), np.int64).tolist())))

    def _keep_few(self, pairs: dict[str, tuple[int, int]]) -> None:
        blocks = [np.array([p[k] for p in pairs.values()], np.int64).tobytes() for k in range(2)]
        self.few.update((False, list(pairs), *blocks))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["us", self.row_id], kind="stable")
        at = new["us"].to_numpy(dtype=np.int64)
        mine = new[(new["home"] == key[1]) & new["payee"].notna() & ~new["known"].astype(bool)].drop_duplicates("payee")
        fresh = {p: (int(us), int(i)) for p, us, i in mine[["payee", "us", self.row_id]].itertuples(index=False)}
        before = timerValues.getCurrentWatermarkInMs() * 1000 - self.keep
        large, held = self._held()
        if not large:
            held = {p: f for p, f in held.items() if f[0] >= before}
            for payee, first in fresh.items():
                held[payee] = min(first, held.get(payee, first))
            times = np.sort(np.array([us for us, _ in held.values()], np.int64))
            if len(held) <= self.small:
                self._keep_few(held)
            else:
                self._merge(held)
                self.few.update((True, [], b"", b""))
        else:
            times = self._merge(fresh, at)
            self._forget({int(k[0]) for k in self.recent.keys()}, before)
        out = {self.account: key[0], self.row_id: new[self.row_id].to_numpy(), "shard": key[1]}
        for name, span in self.spans.items():
            out[name] = np.searchsorted(times, at, "left") - np.searchsorted(times, at - span, "left")
        self.handle.registerTimer(int((int(at.max()) + self.keep) // 1000) + 1)
        yield pd.DataFrame(out)

    def _merge(self, fresh: dict[str, tuple[int, int]], at: np.ndarray | None = None) -> np.ndarray:
        """Put first payments into the maps; the times of those in the spans before ``at``, sorted."""
        touched: dict[int, dict[str, int]] = {}

        def hour(h: int) -> dict[str, int]:
            if h not in touched:
                touched[h] = self._hour(h)
            return touched[h]

        changed = set()
        for payee, (us, row) in fresh.items():
            if self.firsts.containsKey((payee,)):
                was = self.firsts.getValue((payee,))
                if tuple(was) <= (us, row):
                    continue
                hour(was[0] // HOUR_US).pop(payee, None)  # a late row is the first one after all
                changed.add(was[0] // HOUR_US)
            self.firsts.updateValue((payee,), (us, row))
            hour(us // HOUR_US)[payee] = us
            changed.add(us // HOUR_US)
        for h in changed:
            self._put(h, touched[h])
        if at is None:
            return np.empty(0, np.int64)
        reach, own = max(self.spans.values()) // HOUR_US + 1, np.unique(at // HOUR_US)
        stored = [int(k[0]) for k in self.recent.keys()]
        wanted = [h for h in stored if np.searchsorted(own, h, "left") < np.searchsorted(own, h + reach, "right")]
        return np.sort(np.array([us for h in wanted for us in hour(h).values()], np.int64))

    def _forget(self, hours: set[int], before: int) -> None:
        for h in [h for h in hours if (h + 1) * HOUR_US <= before]:
            for payee in self._hour(h):
                self.firsts.removeKey((payee,))
            self.recent.removeKey((h,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = timerValues.getCurrentWatermarkInMs() * 1000 - self.keep
        large, held = self._held()
        if large:
            self._forget({int(k[0]) for k in self.recent.keys()}, before)
            if not any(True for _ in self.recent.keys()):
                self.few.clear()
        elif held := {p: f for p, f in held.items() if f[0] >= before}:
            self._keep_few(held)
        else:
            self.few.clear()
        yield from ()

    def close(self) -> None:
        pass
