"""Quality classifier: a factorisation machine on hashed words, structure and metadata.

A document is a sparse vector: hashed words with damped counts and unit length, statistics of
its structure (symbols, capitals, repeats, lines...) and its stated length, standardised. The
machine has a weight for each feature and a short vector for each, whose products weigh pairs of
features. The sum over all pairs is computed in linear time as half the sum, over the factors, of
(sum of v x) squared minus the sum of (v x) squared.

It is fitted in one task on a sample of about ``SAMPLE`` labelled documents, which Spark draws and
turns into features; every text is scored whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, uniform

WORDS = 2048  # hash buckets of words
FACTORS = 6
SAMPLE = 8000
THRESHOLD = 0.3
EPOCHS = 12
BATCH = 128
RATE = 0.02
DECAY = 1e-5

STATS = (
    "words", "word_length", "symbols", "capitals", "shouts", "bars", "digits", "distinct", "top_word", "repeats", "lines",
    "line_repeats", "line_words", "stops", "stated_length", "stated_gap",
)
_SYMBOLS = re.compile(r"[#*$%&<>=~^_\\@]")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"\d")
_STOPS = re.compile(r"[.?!…][\"')\]]*(?:\s|$)")


def features(text: str | None, stated: float | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of the words, their values, and the statistics in the order of ``STATS``."""
    text = text or ""
    tokens = text.split()
    n, chars = len(tokens), max(1, len(text))
    counts = Counter(tokens)
    lowered: dict[int, float] = {}
    for w, c in counts.items():
        b = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % words
        lowered[b] = lowered.get(b, 0) + c
    index = np.array(sorted(lowered), dtype=np.int64)
    value = 1 + np.log([lowered[b] for b in index]) if lowered else np.empty(0)
    value = value / np.sqrt((value**2).sum()) if lowered else value
    lines = [x for x in text.split("\n") if x.strip()]
    some = max(1, n)
    stated = float(len(text)) if stated is None or stated != stated else float(stated)
    stats = np.array([
        math.log1p(n), sum(map(len, tokens)) / some, len(_SYMBOLS.findall(text)) / some, len(_CAPITALS.findall(text)) / chars,
        text.count("!") / some, text.count("|") / some, len(_DIGITS.findall(text)) / chars, len(counts) / some,
        max(counts.values(), default=0) / some, sum(a == b for a, b in zip(tokens, tokens[1:])) / some, math.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), len(_STOPS.findall(text)) / some,
        math.log1p(max(0.0, stated)), min(1.0, abs(stated - len(text)) / chars),
    ])
    return index, value, stats


@dataclass
class Model:
    """Plain arrays of WORDS + len(STATS) features; small enough for every task."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    words: int = WORDS

    def score(self, text: str | None, stated: float | None) -> float:
        index, value, stats = features(text, stated, self.words)
        i = np.concatenate([index, np.arange(self.words, self.words + len(STATS))])
        x = np.concatenate([value, np.clip((stats - self.mean) / self.spread, -5, 5)])
        vx = self.factors[i] * x[:, None]
        z = self.bias + self.linear[i] @ x + 0.5 * float((vx.sum(0) ** 2 - (vx**2).sum(0)).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
        label_col: str = "quality", sample: int = SAMPLE, words: int = WORDS, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on a hashed sample of about ``sample`` labelled documents.

    A document with several labels counts once, by their mean. Labels or ids that are null, and
    labels without a document, teach nothing. Without both classes the model knows the constant
    share of label 1 only (one half without any label).
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(
        (F.avg(label_col) >= 0.5).cast("double").alias("label"))
    n = known.count()
    chosen = known.where(uniform("quality-sample", F.col("doc_id")) < min(1.0, sample / max(1, n)))
    length = F.lit(None).cast("double") if length_col is None else F.col(length_col).cast("double")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), length.alias("stated"))
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("key", F.xxhash64("doc_id", "text"))  # about ``sample`` ids, at most

    def extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [features(t, s, words) for t, s in zip(part["text"], part["stated"])]
            yield pd.DataFrame({"key": part["key"], "label": part["label"], "i": [g[0] for g in got], "v": [g[1] for g in got], "s": [g[2] for g in got]})

    rows = materialise(rows.mapInPandas(extract, "key long, label double, i array<long>, v array<double>, s array<double>"), "quality-sample")
    k = len(STATS)
    moments = rows.select("label", *[F.get("s", F.lit(j)).alias(f"s{j}") for j in range(k)]).agg(
        F.avg("label").alias("share"), *[F.avg(f"s{j}").alias(f"m{j}") for j in range(k)], *[F.stddev_pop(f"s{j}").alias(f"d{j}") for j in range(k)]).first()
    share = moments["share"]
    mean = np.array([moments[f"m{j}"] or 0.0 for j in range(k)])
    spread = np.array([moments[f"d{j}"] or 1.0 for j in range(k)])
    spread[spread < 1e-9] = 1.0
    if share is None or share in (0.0, 1.0):
        z = 0.0 if share is None else math.log((share + 0.05) / (1.05 - share))
        return Model(z, np.zeros(words + k), np.zeros((words + k, 1)), mean, spread, words)

    size = words + k

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        yield pd.DataFrame([_descend(rows, mean, spread, words, epochs, seed)], columns=["bias", "linear", "factors"])

    one = rows.repartition(1).sortWithinPartitions("key")  # the sample is bounded, and in a fixed order
    got = one.mapInPandas(learn, "bias double, linear array<double>, factors array<double>").first()
    return Model(got["bias"], np.array(got["linear"]), np.array(got["factors"]).reshape(size, FACTORS), mean, spread, words)


def _descend(rows: pd.DataFrame, mean: np.ndarray, spread: np.ndarray, words: int, epochs: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the logistic loss; gradients of the pairs come from the same sums as the score."""
    k, rng = len(STATS), np.random.default_rng(seed)
    size = words + k
    x = np.clip((np.stack(list(rows["s"])) - mean) / spread, -5, 5)
    index = [np.concatenate([i, np.arange(words, size)]).astype(np.int64) for i in rows["i"]]
    value = [np.concatenate([v, s]) for v, s in zip(rows["v"], x)]
    y = rows["label"].to_numpy()
    # a column a feature: its weight, then its factors; the last row holds the bias
    w = np.concatenate([np.zeros((size + 1, 1)), rng.normal(0, 0.02, (size + 1, FACTORS))], axis=1)
    w[size, 0] = math.log((y.mean() + 0.01) / (1.01 - y.mean()))
    m, s2, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            i, v = np.concatenate([index[j] for j in batch]), np.concatenate([value[j] for j in batch])
            at = np.repeat(np.arange(len(batch)), [len(index[j]) for j in batch])
            starts = np.searchsorted(at, np.arange(len(batch)))
            vx = w[i, 1:] * v[:, None]
            sums = np.add.reduceat(vx, starts)
            z = w[size, 0] + np.add.reduceat(w[i, 0] * v, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            g = np.empty((len(i), 1 + FACTORS))
            g[:, 0] = e[at] * v
            g[:, 1:] = (e[at] * v)[:, None] * (sums[at] - vx)
            grad = DECAY * w
            np.add.at(grad, i, g)
            grad[size] = 0
            grad[size, 0] = e.sum()
            step += 1
            m, s2 = 0.9 * m + 0.1 * grad, 0.999 * s2 + 0.001 * grad**2
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.999**step)) + 1e-8)
    return float(w[size, 0]), w[:size, 0].copy(), w[:size, 1:].ravel()


def score(docs: DataFrame, model: Model, text_col: str = "text", length_col: str | None = "n_chars", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, 0 to 1; null text is scored as empty text."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lengths in parts:
            yield pd.Series([model.score(t, s) for t, s in zip(texts, lengths)], dtype="float64")

    length = F.lit(None).cast("double") if length_col is None else F.col(length_col).cast("double")
    return docs.withColumn(name, F.pandas_udf(run, "double")(F.col(text_col), length))
