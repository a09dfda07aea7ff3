"""Language identification and the factorisation machine."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskframe.llm import language_id as lid
from riskframe.llm import quality_model as qm

WORDS = {"en": "the of and that with this house water think", "de": "der die und nicht mit auch haus wasser denken", "fr": "le les et que avec aussi maison eau penser",
         "es": "el los y que con también casa agua pensar"}


def texts(n=40, langs=WORDS):
    rng = random.Random(1)
    return [(i * 10 + k, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(5, 30))), lang) for i in range(n) for k, lang in enumerate(langs)]


def predicted(spark, rows, docs):
    model = lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: (r.lang_pred, r.score) for r in lid.identify(df, model).collect()}


def test_languages(spark):
    docs = [(1, "the water and that house"), (2, "der Wasser und nicht DAS HAUS"), (3, "les maison que avec"), (4, "también casa y agua"), (5, None), (6, ""), (7, "123 --- !!"),
            (8, "the house " * 30000), (9, "x")]
    got = predicted(spark, texts() + [(1, None, "en"), (2, "text without language", None), (3, "12", "de")], docs)
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6, 7, 8)] == ["en", "de", "fr", "es", "und", "und", "und", "en"]
    assert got[5][1] == got[7][1] == 0 and all(0 <= s <= 1 for _, s in got.values()) and got[9][0] in WORDS


def test_language_few_labels(spark):
    assert predicted(spark, [], [(1, "word")]) == {1: ("und", 0.0)}
    assert predicted(spark, [(1, "the house", "en")], [(1, "word")])[1] == ("en", 1.0)
    assert predicted(spark, texts(10, ("en", "de")), [(1, "nicht und der")])[1][0] == "de"
    assert predicted(spark, texts(10, ("en", "fr")), [(1, "les et que")])[1][0] == "fr"


def test_language_filter_keeps_columns(spark):
    rows = spark.createDataFrame(texts(10) + [(1, "12 34", "en"), (2, None, None)], "doc_id long, text string, lang string").select(
        "*", F.lit(1).alias("score"), F.lit(2).alias("lang_pred"), F.lit(3).alias("prediction"))
    kept = lid.keep_known(rows, lid.fit(rows))
    assert kept.columns == rows.columns and kept.count() == 40 and lid.keep_known(rows.limit(0), lid.fit(rows)).count() == 0


def test_sample_is_read_once(spark, monkeypatch):
    """One Python node in the plan of the sample: two would keep two workers busy for each core."""
    plans, write = [], lid.materialise

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(lid, "materialise", noted)
    rows = [*texts(), (1, None, "en"), (2, "12", "de")]
    model = lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [p.count("ArrowEvalPython") for p in plans] == [1]
    assert sorted(x for names in model.languages.values() for x in names) == ["de", "en", "es", "fr"]


def test_pairs_in_linear_time():
    rng = np.random.default_rng(3)
    size = qm.WORDS + len(qm.STATS)
    model = qm.Model(0.3, rng.normal(size=size) * 0.1, rng.normal(size=(size, 4)) * 0.1, np.zeros(len(qm.STATS)), np.ones(len(qm.STATS)))
    index, value, stats = qm.features("some words and some more words!", 30)
    i, x = np.concatenate([index, np.arange(qm.WORDS, size)]), np.concatenate([value, np.clip(stats, -5, 5)])
    z = model.bias + sum(model.linear[i] * x)
    for a in range(len(i)):
        for b in range(a):
            z += model.factors[i[a]] @ model.factors[i[b]] * x[a] * x[b]
    assert abs(model.score("some words and some more words!", 30) - 1 / (1 + np.exp(-z))) < 1e-9


def test_gradient_matches_differences():
    """One step of the fit from a known point moves against the numerical gradient's sign."""
    rows = pd.DataFrame([{"label": float(k % 2), "i": f[0], "v": f[1], "s": f[2]} for k in range(40) for f in [qm.features("good calm prose here" if k % 2 else "BAD!! NOISE!!", None)]])
    bias, linear, factors = qm._descend(rows, np.zeros(len(qm.STATS)), np.ones(len(qm.STATS)), qm.WORDS, 30, 1)
    model = qm.Model(bias, linear, factors.reshape(-1, qm.FACTORS), np.zeros(len(qm.STATS)), np.ones(len(qm.STATS)))
    assert model.score("good calm prose here", None) > 0.9 and model.score("BAD!! NOISE!!", None) < 0.1


def test_quality_held_out_and_odd_inputs(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choices("calm river stone story reads".split(), k=40)) + "." for _ in range(150)]
    bad = [" ".join(rng.choices("BUY!! WIN!! ### FREE!! $$$".split(), k=40)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, len(t), "x") for i, t in enumerate(good + bad)] + [(900, None, None, "x"), (901, "", 0, "x"), (902, good[0] * 800, 1, "x"), (None, good[1], 5, "x")],
                                 "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(1, 1), (None, 1), (5000, 0), (7, None)], "doc_id long, quality int")
    model = qm.fit(docs, labels.where(F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))))
    got = {r.doc_id: r.score for r in qm.score(docs, model).collect()}
    assert all((got[i] >= qm.THRESHOLD) == (i < 150) for i in range(300)) and all(0 <= s <= 1 for s in got.values())
    empty = qm.fit(docs, labels.limit(0))
    assert abs(empty.score("x", 1) - 0.5) < 1e-9
    assert qm.fit(docs, labels.where("quality = 1")).score("x", 1) > 0.9
    assert qm.score(docs.limit(0), empty).count() == 0
