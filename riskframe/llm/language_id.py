"""Language identification in two steps: family, then one against one within the family.

Texts are seen as frequencies of hashed character pairs and triples of their letters. A
multinomial logistic regression tells the family; within it, a linear support vector machine for
each pair of languages votes, and the language with most votes (then the largest summed margin)
is predicted. The models are fitted, each in a task, on a sample of about ``PER_LANGUAGE`` labelled
documents for each language; every text is predicted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, uniform

DIM = 1024
PER_LANGUAGE = 1000
UNDETERMINED = "und"
MIN_SCORE = 0.35
RIDGE = 1e-3

# Languages by family. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "ne", "pa"),
    "sinitic": ("zh", "yue"),
    "semitic": ("ar", "he", "mt"),
}

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def family_of(lang: str) -> str:
    base = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, members in FAMILIES.items() if base in members), lang)


def buckets(text: str | None, dim: int = DIM) -> np.ndarray:
    """Hash buckets of the character pairs and triples of the letters; empty without a letter."""
    if not text:
        return np.empty(0, np.int64)
    letters = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, letters)):
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    pairs = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    triples = pairs[:-1] + c[2:] * np.uint64(0x165667B19E3779F9)
    h = np.concatenate([pairs, triples ^ np.uint64(0x85EBCA77C2B2AE63)])
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.int64) % dim


@dataclass
class Model:
    """Weights by hash bucket; plain arrays, small enough for every task."""

    dim: int
    families: list[str] = field(default_factory=list)
    family_weights: np.ndarray | None = None  # buckets x families
    family_bias: np.ndarray | None = None
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        b = buckets(text, self.dim)
        if not len(b) or not self.families:
            return UNDETERMINED, 0.0
        x = np.bincount(b, minlength=self.dim) / len(b)
        sure, family = 1.0, self.families[0]
        if self.family_weights is not None:
            z = x @ self.family_weights + self.family_bias
            p = np.exp(z - z.max())
            best = int(p.argmax())
            sure, family = float(p[best] / p.sum()), self.families[best]
        names = self.languages[family]
        if len(names) == 1:
            return names[0], sure
        votes, margins = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for a, c in combinations(names, 2):
            w, bias = self.pairs[a, c]
            m = float(x @ w + bias)
            votes[c if m > 0 else a] += 1
            margins[c] += m
            margins[a] -= m
        lang = max(names, key=lambda n: (votes[n], margins[n], n))
        return lang, sure / (1 + float(np.exp(-max(-30.0, min(30.0, 4 * margins[lang] / (len(names) - 1))))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns with mean 0 and deviation 1, and these; constant columns are 0."""
    mean, dev = x.mean(0), x.std(0)
    factor = np.where(dev > 1e-12, 1 / np.maximum(dev, 1e-12), 0.0)
    return (x - mean) * factor, mean, factor


def _softmax(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and biases of a multinomial logistic regression, by accelerated gradient steps."""
    x, mean, factor = _scaled(x)
    x = np.column_stack([x, np.ones(len(x))])
    v = np.ones(x.shape[1])
    for _ in range(30):  # the largest curvature
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    pace = 1 / (0.5 * np.linalg.norm(x @ v) ** 2 / len(x) * 1.05 + RIDGE)
    want = np.eye(classes)[y]
    w = ahead = np.zeros((x.shape[1], classes))
    for k in range(steps):
        z = x @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - pace * (x.T @ (p - want) / len(x) + RIDGE * ahead)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    weights = w[:-1] * factor[:, None]
    return weights, w[-1] - mean @ weights


def _machine(x: np.ndarray, y: np.ndarray, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a linear support vector machine with squared hinge loss, by Newton steps; y is -1 or 1."""
    x, mean, factor = _scaled(x)
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-9

    def loss(w: np.ndarray) -> float:
        return float((np.maximum(0, 1 - y * (x @ w)) ** 2).mean() + (ridge * w * w).sum())

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        close = y * (x @ w) < 1
        a = x[close]
        slope = 2 * a.T @ (a @ w - y[close]) / len(x) + 2 * ridge * w
        move = np.linalg.solve(2 * a.T @ a / len(x) + np.diag(2 * ridge), slope)
        size = 1.0
        while size > 1e-4 and (new := loss(w - size * move)) > now:
            size /= 2
        if size <= 1e-4 or now - new < 1e-9:
            break
        w, now = w - size * move, new
    weights = w[:-1] * factor
    return weights, np.array([w[-1] - mean @ weights])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, dim: int = DIM, least: int = 1) -> Model:
    """Fit the models on a hashed sample of about ``per_language`` documents of each language.

    Languages of fewer than ``least`` documents are not learned; as those that are come to the driver by
    name, a dirty column needs a higher one. The family's model sees about two times
    ``per_language`` documents of each family. Every model is fitted in a task of its own, all in one job. Rows without language or
    without letters teach nothing. Without any, the model predicts ``und``; with one language or
    family, the steps that have no choice are left out.
    """
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().where(F.col("count") >= least).collect()}
    model = Model(dim)
    if not counts:
        return model
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_language / n))])
    chosen = labelled.where(F.col("lang").isin(list(counts))).where(uniform("language-sample", F.col("text")) < share[F.col("lang")])
    rows = chosen.select("lang", uniform("family-sample", F.col("text")).alias("draw"), _vector_udf(dim)("text").alias("x"))
    rows = materialise(rows, "language-sample").where(F.col("x").isNotNull())  # a filter before would compute x twice, in two workers a core
    known = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    for lang in sorted(known):
        model.languages.setdefault(family_of(lang), []).append(lang)
    model.languages = dict(sorted(model.languages.items()))
    model.families = list(model.languages)
    # the tasks that a document takes part in: its family against the others, its language against each of the family
    pairs = [p for names in model.languages.values() for p in combinations(names, 2)]
    work = {lang: [k for k, p in enumerate(pairs) if lang in p] for lang in known}
    sizes = {f: sum(known[lang] for lang in names) for f, names in model.languages.items()}
    several = len(model.families) > 1
    if not several and not pairs:
        return model
    draw = F.create_map(*[F.lit(v) for f, names in model.languages.items() for lang in names for v in (lang, 2.0 * per_language / sizes[f] if several else 0.0)])
    mine = F.create_map(*[x for lang in known for x in (F.lit(lang), F.array(*map(F.lit, work[lang])).cast("array<int>"))])
    tasks = F.concat(mine[F.col("lang")], F.when(F.col("draw") < draw[F.col("lang")], F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    families = {lang: model.families.index(f) for f, names in model.languages.items() for lang in names}

    def learn(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["draw", "lang"], kind="stable")  # sums do not depend on the order of rows
        x = np.stack(d["x"].to_numpy()).astype(float)
        if key[0] < 0:
            w, b = _softmax(x, d["lang"].map(families).to_numpy(), len(set(families.values())))
        else:
            w, b = _machine(x, np.where(d["lang"] == pairs[key[0]][1], 1.0, -1.0))
        return pd.DataFrame({"task": [key[0]], "w": [w.ravel()], "b": [b]})

    fitted = rows.select("lang", "draw", "x", F.explode(tasks).alias("task")).groupBy("task").applyInPandas(learn, "task int, w array<double>, b array<double>")
    for r in fitted.collect():  # one row for each model, whatever the number of documents
        if r["task"] < 0:
            model.family_weights, model.family_bias = np.array(r["w"]).reshape(dim, -1), np.array(r["b"])
        else:
            model.pairs[pairs[r["task"]]] = np.array(r["w"]), r["b"][0]
    return model


def _vector_udf(dim: int):
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([np.bincount(b, minlength=dim) / len(b) if len(b := buckets(t, dim)) else None for t in part], dtype=object)

    return F.pandas_udf(vectors, "array<double>")


def _predict_udf(model: Model):
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([model.predict(t) for t in part], columns=["lang", "score"])

    return F.pandas_udf(predict, "lang string, score double")


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs``, the predicted language and a score from 0 to 1.

    Null text and text without a letter are ``und`` with score 0. Columns of ``docs`` named like
    the two new ones are replaced.
    """
    tmp = free_name(docs, "prediction")[0]
    rows = docs.withColumn(tmp, _predict_udf(model)(F.col(text_col)))
    return rows.withColumns({lang_pred: F.col(f"{tmp}.lang"), score: F.col(f"{tmp}.score")}).drop(tmp)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Documents in a language that the model knows, with all their columns.

    Those without a letter go, and those whose score is below ``min_score``: neither family nor
    language is clear then.
    """
    lang, score = free_name(docs, "lang_pred", "score")
    rows = identify(docs, model, text_col, lang, score)
    return rows.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score)).select(*docs.columns)
