"""Removal of byte strings of ``LENGTH`` or more that occur anywhere else, by repeat intervals of suffixes.

Sorting every suffix of a corpus is out of reach, so the suffixes are first put in groups that
hold all their repeats. Each string of LENGTH bytes has an anchor: the substring of ``ANCHOR``
bytes in it with the smallest hash. Equal strings have equal anchors, so repeats are found within
the strings of one anchor. Neighbouring strings share anchors: a text falls into runs of
strings, one for about 85 bytes, and only runs whose anchor occurs twice go on.

* Runs with equal contexts (all bytes that their strings touch) are repeats as a whole.
* The other contexts of an anchor are compared: an enhanced suffix array (suffixes in order and
  the common prefix of neighbours) is scanned with a stack for common-prefix intervals; those
  whose members have different bytes to the left are the maximal repeats, with all occurrences.
* The contexts of an anchor with more than ``LARGE`` of them are compared string by string, by
  counting hashes over the cluster, with the same result.

Texts travel once in a join; those with compared contexts a second time, compressed. Positions
are bytes of UTF-8, and a position belongs to one text, so no match crosses documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling_hash as rh
from .common import materialise, text_key, whole_groups

LENGTH = 200
ANCHOR = 32
BLOCK = 1 << 20
LARGE = 2000
BATCH = 3000  # contexts whose suffixes are sorted at a time

FULL, COMPARE, SAMPLE = 0, 1, 2  # what to do with a run: remove it, compare its context, lend its context


def _leftmost_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest value of each v[p : p + width]."""
    at, low, have = np.arange(len(v)), v, 1
    while have * 2 <= width:
        left, right = low[:-have], low[have:]
        take = right < left
        at, low, have = np.where(take, at[have:], at[:-have]), np.where(take, right, left), have * 2
    shift = width - have
    if shift:
        take = low[shift:] < low[:-shift]
        at = np.where(take, at[shift:], at[:-shift])
    return at


def runs(raw: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text number, first start, last start, anchor hash, context hash) of every run of strings."""
    out: list[tuple[np.ndarray, ...]] = []
    batch: list[tuple[int, int, bytes]] = []  # text number, offset, bytes

    def flush() -> None:
        if not batch:
            return
        sizes = np.array([len(b) for _, _, b in batch])
        data = np.frombuffer(b"".join(b for _, _, b in batch), np.uint8)
        sums = rh.prefix(data)
        n = len(data)
        p = np.arange(n - anchor + 1)
        at = _leftmost_minimum(rh.substrings(sums, p, p + anchor), length - anchor + 1)
        end = np.cumsum(sizes)
        part = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
        ok = np.flatnonzero(np.arange(len(at)) + length <= end[part])
        new = np.concatenate([[True], (at[ok[1:]] != at[ok[:-1]]) | (part[ok[1:]] != part[ok[:-1]])])
        first = ok[new]
        last = ok[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ok) - 1]])]
        a = at[first]
        context = rh.mix(rh.substrings(sums, first, last + length) + (a - first).astype(np.uint64))
        which = part[first]
        origin = end[which] - sizes[which]
        number, offset = np.array([b[0] for b in batch]), np.array([b[1] for b in batch])
        move = offset[which] - origin
        out.append((number[which], first + move, last + move, rh.substrings(sums, a, a + anchor).view(np.int64), context.view(np.int64)))
        batch.clear()

    total = 0
    for number, text in enumerate(raw):
        for offset in range(0, max(0, len(text) - length + 1), BLOCK):
            piece = text[offset : offset + BLOCK + length - 1]
            if total + len(piece) > BLOCK:
                flush()
                total = 0
            batch.append((number, offset, piece))
            total += len(piece)
    flush()
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def common_prefix_intervals(prefixes: list[int], least: int) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the intervals of a suffix array that share ``depth`` >= least bytes.

    ``prefixes[i]`` is the common prefix of suffixes i - 1 and i; the first one is not used.
    """
    out, stack = [], []  # open intervals: depth, first
    for i in range(1, len(prefixes) + 1):
        depth = prefixes[i] if i < len(prefixes) else 0
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            out.append((d, first, i - 1))
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


def maximal_repeats(group: np.ndarray, contexts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context the intervals that are covered by repeats of ``length`` within its group."""
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    sizes = np.array([len(c) for c in contexts])
    if not len(sizes):
        return found
    data = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    part = np.repeat(np.arange(len(sizes)), sizes)
    start = np.flatnonzero(np.arange(len(data)) + length <= ends[part])
    which = part[start]
    h = rh.mix(rh.substrings(rh.prefix(data), start, start + length) + rh.mix(group[which].astype(np.int64).view(np.uint64)))
    order = np.argsort(h, kind="stable")
    s, hs = start[order], h[order]
    new = np.concatenate([[True], hs[1:] != hs[:-1]])
    number = np.cumsum(new) - 1
    many = np.bincount(number)[number] > 1
    # a suffix without a byte to its left differs from every other one
    left = np.where(s == begins[part[s]], -1 - s, data[np.maximum(s - 1, 0)].astype(np.int64))
    low, high = np.minimum.reduceat(left, np.flatnonzero(new)), np.maximum.reduceat(left, np.flatnonzero(new))
    heads = s[many & (low != high)[number]]
    if not len(heads):
        return found
    whole = data.tobytes()
    suffixes = sorted((int(group[part[i]]), whole[i : ends[part[i]]], int(i)) for i in heads)
    prefixes, changes = [0], [0]
    lefts = [(-1 - i if i == begins[part[i]] else whole[i - 1]) for _, _, i in suffixes]
    for k in range(1, len(suffixes)):
        (g, a, _), (f, b, _) = suffixes[k - 1], suffixes[k]
        n = 0
        if g == f and a[:length] == b[:length]:
            n, most = length, min(len(a), len(b))
            while n < most and a[n] == b[n]:
                n += 1
        prefixes.append(n)
        changes.append(changes[-1] + (lefts[k] != lefts[k - 1]))
    # the deepest interval of each suffix that cannot be extended to the left covers the others
    following = list(range(len(suffixes) + 1))

    def next_open(i: int) -> int:
        while following[i] != i:
            following[i] = following[following[i]]
            i = following[i]
        return i

    for depth, first, last in sorted(common_prefix_intervals(prefixes, length), reverse=True):
        if changes[last] == changes[first]:
            continue
        i = next_open(first)
        while i <= last:
            at = suffixes[i][2]
            c = int(part[at])
            found[c].append((at - int(begins[c]), at - int(begins[c]) + depth))
            following[i] = i + 1
            i = next_open(i)
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint intervals, in order, that cover the same positions."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    spans = merged(spans)
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return sum(b - a for a, b in spans), len(spans), b"".join(kept)


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _emit_runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        number, first, last, anchor, context = runs([_utf8(t) for t in part["text"]])
        k1, k2 = part["k1"].to_numpy(), part["k2"].to_numpy()
        yield pd.DataFrame({"k1": k1[number], "k2": k2[number], "anchor": anchor, "context": context, "run": first * 256 + (last - first)})


def _emit_contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From texts and their runs: finished texts, texts that wait for comparisons, and contexts."""
    columns = ["k1", "k2", "kind", "n_removed", "n_spans", "sha", "data", "fulls", "anchor", "start", "compare"]
    pack = zstandard.ZstdCompressor(level=1)
    for part in parts:
        rows = []
        for k1, k2, text, todo in zip(part["k1"], part["k2"], part["text"], part["todo"]):
            raw = _utf8(text)
            fulls, waits = [], False
            for t in todo:
                first, last = t["run"] // 256, t["run"] // 256 + t["run"] % 256 + LENGTH
                if t["what"] == FULL:
                    fulls.append((first, last))
                else:
                    waits |= t["what"] == COMPARE
                    rows.append((k1, k2, "context", None, None, None, raw[first:last], None, t["anchor"], first, t["what"] == COMPARE))
            fulls = merged(fulls)
            if waits:
                rows.append((k1, k2, "waiting", None, None, None, pack.compress(raw), [x for s in fulls for x in s], None, None, None))
            elif fulls:
                n, spans, kept = _without(raw, fulls)
                rows.append((k1, k2, "done", n, spans, hashlib.sha256(kept).hexdigest(), None, None, None, None, None))
            if len(rows) > 2000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)


_EMITTED = "k1 long, k2 long, kind string, n_removed long, n_spans long, sha string, data binary, fulls array<long>, anchor long, start long, compare boolean"


def _compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Covered spans from contexts that arrive ordered by anchor; whole anchors are compared at a time."""
    for rows in whole_groups(parts, ["anchor"], BATCH):
        spans = maximal_repeats(rows["anchor"].to_numpy(), list(rows["data"]))
        out = [(k1, k2, start + a, start + b) for k1, k2, start, compare, found in
               zip(rows["k1"], rows["k2"], rows["start"], rows["compare"], spans) if compare for a, b in merged(found)]
        yield pd.DataFrame(out, columns=["k1", "k2", "first", "last"])


def _emit_strings(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for i in range(0, len(part), 2000):
            rows = part.iloc[i : i + 2000]
            sizes = np.array([len(d) for d in rows["data"]])
            begins = np.cumsum(sizes) - sizes
            n = sizes - LENGTH + 1
            which = np.repeat(np.arange(len(rows)), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = begins[which] + offset
            h = rh.substrings(rh.prefix(np.frombuffer(b"".join(rows["data"]), np.uint8)), at, at + LENGTH).view(np.int64)
            yield pd.DataFrame({c: rows[c].to_numpy()[which] for c in ("k1", "k2", "anchor", "compare")} | {"string": h, "first": rows["start"].to_numpy()[which] + offset})


def _finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor()
    for part in parts:
        rows = []
        for k1, k2, data, fulls, spans in zip(part["k1"], part["k2"], part["data"], part["fulls"], part["spans"]):
            pairs = [(int(fulls[i]), int(fulls[i + 1])) for i in range(0, len(fulls), 2)]
            if spans is not None:
                pairs += [(int(s["first"]), int(s["last"])) for s in spans]
            n, m, kept = _without(unpack.decompress(data), pairs)
            rows.append((k1, k2, n, m, hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(rows, columns=["k1", "k2", "n_removed", "n_spans", "sha"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text is empty text: nothing to remove. Texts of fewer than LENGTH bytes stay whole. Equal
    texts, repeated rows too, are repeats of each other. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), *text_key(text, "k"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    texts = docs.where(F.octet_length(F.col(text_col)) >= LENGTH).select(*text_key(F.col(text_col), "k"), F.col(text_col).alias("text"))
    found = texts.mapInPandas(_emit_runs, "k1 long, k2 long, anchor long, context long, run long")
    twice = found.groupBy("anchor").count().where("count > 1").select("anchor")
    found = materialise(found.join(twice, "anchor"), "suffix-runs")

    same = found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "run")).alias("sample"))
    kinds = same.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    same = materialise(same.join(kinds, "anchor"), "suffix-contexts")
    todo = found.join(same.select("anchor", "context", "n"), ["anchor", "context"]).select(
        "k1", "k2", "run", "anchor", F.when(F.col("n") > 1, FULL).otherwise(COMPARE).alias("what"))
    lent = same.where("n > 1 and least = 1").select("sample.k1", "sample.k2", "sample.run", "anchor", F.lit(SAMPLE).alias("what"))
    todo = todo.union(lent).groupBy("k1", "k2").agg(F.collect_set(F.struct("run", "anchor", "what")).alias("todo"))
    single = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    emitted = materialise(single.join(todo, ["k1", "k2"]).select("k1", "k2", "text", "todo").mapInPandas(_emit_contexts, _EMITTED), "suffix-emitted")

    contexts = emitted.where("kind = 'context'").select("k1", "k2", "anchor", "start", "compare", "data")
    large = kinds.where(F.col("kinds") > LARGE).select("anchor")
    big, few = contexts.join(large, "anchor", "left_semi"), contexts.join(large, "anchor", "left_anti")
    few = few.repartition("anchor").sortWithinPartitions("anchor")
    spans = few.mapInPandas(_compare, "k1 long, k2 long, first long, last long")
    strings = materialise(big.mapInPandas(_emit_strings, "k1 long, k2 long, anchor long, compare boolean, string long, first long"), "suffix-strings")
    again = strings.groupBy("anchor", "string").count().where("count > 1").select("anchor", "string")
    spans = spans.union(strings.where("compare").join(again, ["anchor", "string"]).select("k1", "k2", "first", F.col("first") + LENGTH))
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    waiting = emitted.where("kind = 'waiting'").select("k1", "k2", "data", "fulls").join(spans, ["k1", "k2"], "left")
    results = waiting.mapInPandas(_finish, "k1 long, k2 long, n_removed long, n_spans long, sha string")
    results = results.union(emitted.where("kind = 'done'").select("k1", "k2", "n_removed", "n_spans", "sha"))
    return own.join(results, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"))
