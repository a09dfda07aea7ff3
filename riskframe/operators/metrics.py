"""Evaluation: ROC, confusion scores, concordance, calibration, thresholds, value KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .chunks import CHUNKS, attach_totals, exact_quantiles, row_numbers, running


def _by_score(df: DataFrame, keys: list[str], score: str, label: str, weight: Column | None) -> DataFrame:
    """Positive and negative weight per distinct score (combined before the shuffle).

    Checkpointed: the scans after it read it several times, and the scored rows only once.
    """
    w = weight if weight is not None else F.lit(1.0)
    y = F.col(label).cast("int")
    return cut_lineage(df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(y == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(y == 0, w).otherwise(0.0)).alias("neg")))


def auc(df: DataFrame, score: str, label: str, weight: Column | None = None, keys: list[str] | None = None,
        n_chunks: int | None = CHUNKS) -> DataFrame:
    """Area under the ROC curve per key: the weighted rank sum, ties counted half."""
    keys = keys or []
    per = _by_score(df, keys, score, label, weight)
    ranked = running(per, keys, ["score"], {"below": ("sum", F.col("neg"))}, inclusive=False, n_chunks=n_chunks)
    won = F.sum(F.col("pos") * (F.coalesce("below", F.lit(0.0)) + F.col("neg") / 2))
    return ranked.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
                                     F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))


def auc_by_date(df: DataFrame, score: str, label: str, ts: str, digits: int = 2) -> DataFrame:
    """Mean and population deviation of the per-date AUC rounded half-even."""
    per = auc(df, score, label, keys=[ts]).withColumn("auc", F.bround("auc", digits))
    return per.agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), F.count("auc").alias("dates"))


def roc_points(df: DataFrame, score: str, label: str, weight: Column | None = None, keys: list[str] | None = None,
               drop_collinear: bool = True, n_chunks: int | None = CHUNKS) -> DataFrame:
    """ROC curve: one row per threshold (score at or above it is positive), with fpr and tpr.

    ``drop_collinear`` removes inner points on a straight segment.
    """
    keys = keys or []
    per = _by_score(df, keys, score, label, weight)
    cum = running(per, keys, ["score"], {
        "below_pos": ("sum", F.col("pos")), "below_neg": ("sum", F.col("neg")),
        "lower": ("last", F.struct("pos", "neg")), "rank": ("count", F.lit(1))}, inclusive=False, n_chunks=n_chunks)
    totals = per.groupBy(*keys).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"), F.max("score").alias("__top"))
    j = attach_totals(cum, keys, totals)
    tp = F.col("__p") - F.coalesce("below_pos", F.lit(0.0))
    fp = F.col("__n") - F.coalesce("below_neg", F.lit(0.0))
    if drop_collinear:
        inner = F.col("lower").isNotNull() & (F.col("score") < F.col("__top"))
        straight = (F.col("lower.pos") == F.col("pos")) & (F.col("lower.neg") == F.col("neg"))
        j = j.where(~inner | ~straight)
    return j.select(*keys, F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                    F.try_divide(tp, "__p").alias("tpr"), F.try_divide(fp, "__n").alias("fpr"))


def threshold_at_fpr(df: DataFrame, score: str, label: str, max_fpr: float, keys: list[str] | None = None,
                     drop_collinear: bool = True) -> DataFrame:
    """Lowest threshold whose false-positive rate stays within ``max_fpr`` (infinity if none)."""
    keys = keys or []
    points = roc_points(df, score, label, keys=keys, drop_collinear=drop_collinear)
    return points.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("fpr") <= max_fpr, F.col("threshold"))),
                                                F.lit(float("inf"))).alias("threshold"))


def confusion(label: Column, predicted: Column, weight: Column | None = None) -> list[Column]:
    """Weighted tp, fp, fn, tn as aggregates."""
    w = weight if weight is not None else F.lit(1.0)
    cell = lambda y, p: F.sum(F.when((label == y) & (predicted == p), w).otherwise(0.0))
    return [cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn")]


def classification_scores(df: DataFrame, label: str, predicted: str, weight: Column | None = None,
                          keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1, Matthews correlation, accuracy and balanced accuracy from one aggregation."""
    cells = df.groupBy(*(keys or [])).agg(*confusion(F.col(label), F.col(predicted), weight))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, tnr = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    mcc = F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return cells.select(*(keys or []), "tp", "fp", "fn", "tn", F.try_divide(tp, tp + fp).alias("precision"),
                        recall.alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), mcc.alias("mcc"),
                        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                        ((recall + tnr) / 2).alias("balanced_accuracy"))


def concordance(df: DataFrame, duration: str, event: str, risk: str, n_chunks: int | None = CHUNKS, keys: tuple[str, ...] = (),
                weight: str | None = None) -> DataFrame:
    """Concordance index: share of comparable pairs in which the earlier event has the higher risk.

    With ``keys``, such as a repeat and a fold, one row for each of their values, all in the same pass. ``weight`` is the
    number of equal rows that a row stands for.

    A pair is an event at t against a row lasting longer than t, or censored at t; tied risks
    count half. Pairs are never formed: rows are first counted per (duration, event, risk), and
    the (duration, event) values are numbered in time, an event before what is censored with it.
    Two numbers differ first, from the top, in one binary digit; at that digit the earlier one has
    0 and the later one 1, and all above is equal. So each row takes part once per digit, as
    event or as control of the values that share its higher digits, and each such group is a
    rank sum. Any number of durations costs its logarithm.
    """
    counts = cut_lineage(df.groupBy(*keys, F.col(duration).alias("d"), F.col(event).cast("int").alias("e"),
                                    F.col(risk).cast("double").alias("r")).agg(F.sum(F.col(weight) if weight else F.lit(1)).cast("double").alias("n")))
    values = row_numbers(counts.select("d", "e").distinct(), [], [F.col("d").asc(), F.col("e").desc()], "place", "d", n_chunks)
    values = cut_lineage(values.withColumn("place", F.col("place") - 1))
    digits = max(1, values.count().bit_length())
    placed = counts.join(values, ["d", "e"]).withColumn("digit", F.explode(F.sequence(F.lit(0), F.lit(digits - 1))))
    later = F.expr("shiftright(place, digit) & 1") == 1
    roles = placed.select(*keys, "r", F.concat_ws(":", "digit", F.expr("shiftright(place, digit + 1)")).alias("t"),
                          F.when(~later & (F.col("e") == 1), F.col("n")).otherwise(0.0).alias("cases"), F.when(later, F.col("n")).otherwise(0.0).alias("controls"))
    roles = roles.groupBy(*keys, "t", "r").agg(F.sum("cases").alias("cases"), F.sum("controls").alias("controls"))
    ranked = running(roles, [*keys, "t"], ["r"], {"lower": ("sum", F.col("controls"))}, inclusive=False, n_chunks=n_chunks)
    won = F.col("cases") * (F.coalesce("lower", F.lit(0.0)) + F.col("controls") / 2)
    per = ranked.groupBy(*keys, "t").agg(F.sum(won).alias("won"), (F.sum("cases") * F.sum("controls")).alias("pairs"))
    return per.groupBy(*keys).agg(F.sum("won").alias("concordant"), F.sum("pairs").alias("comparable"),
                   F.try_divide(F.sum("won"), F.sum("pairs")).alias("concordance"))


def cross_validated(scores: DataFrame, score: str = "concordance") -> DataFrame:
    """Mean and sample deviation of the scores of all folds and repeats, and their number; folds without a score are left out."""
    return scores.agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count(score).alias("n"))


def calibration_curve(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score and event rate in uniform bins of the min-max normalised score."""
    bounds = F.broadcast(df.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi")))
    p = F.try_divide(F.col(score) - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    scaled = df.crossJoin(bounds).select(p.alias("p"), F.col(label).cast("double").alias("y"))
    idx = F.least(F.greatest(F.ceil(F.col("p") * bins) - 1, F.lit(0)), F.lit(bins - 1))  # bins closed on the right
    return scaled.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_score"), F.avg("y").alias("event_rate"))


def segment_threshold(df: DataFrame, score: str, segment: str, q: float = 0.95, out: str = "predicted") -> DataFrame:
    """Binarise at the exact q-quantile of the score inside each segment."""
    cut = exact_quantiles(df, [segment], score, [q], ["threshold"])
    return attach_totals(df, [segment], cut).withColumn(out, (F.col(score) >= F.col("threshold")).cast("int"))


def business_kpis(df: DataFrame, company: str, value: str, label: str, predicted: str) -> DataFrame:
    """Count, value and member KPIs in percent.

    Rows are reduced to one per company first, so the distinct member counts are plain sums
    and a busy company is combined before the shuffle.
    """
    y, p, v = F.col(label), F.col(predicted), F.col(value)
    per = df.groupBy(company).agg(*[e for a in (0, 1) for b in (0, 1) for e in (
        F.count_if((y == a) & (p == b)).alias(f"n{a}{b}"), F.sum(F.when((y == a) & (p == b), v).otherwise(0.0)).alias(f"v{a}{b}"))])
    has = lambda *cells: F.count_if(sum((F.col(f"n{c}") for c in cells), F.lit(0)) > 0)
    s = per.agg(*[F.sum(c).cast("double").alias(c) for c in per.columns if c != company],
                has("11").alias("m_tp"), has("01").alias("m_fp"), has("10").alias("m_fn"),
                has("00", "01").alias("m_neg"), has("01", "11").alias("m_alerted"))
    c = F.col
    pct = lambda a, b: F.try_divide(a * 100.0, b)
    alerted, all_n = c("n01") + c("n11"), c("n00") + c("n01") + c("n10") + c("n11")
    v_alert, v_all = c("v01") + c("v11"), c("v00") + c("v01") + c("v10") + c("v11")
    fraud_v = c("v10") + c("v11")
    return s.select(
        alerted.cast("long").alias("blocked"), pct(alerted, all_n).alias("block_rate"),
        pct(c("n11"), alerted).alias("precision"), pct(c("n11"), c("n10") + c("n11")).alias("recall"),
        pct(c("v11"), v_alert).alias("precision_by_value"), pct(c("v11"), fraud_v).alias("recall_by_value"),
        pct(v_alert, v_all).alias("decline_rate"), pct(c("v10"), c("v00") + c("v10")).alias("fraud_exposure"),
        pct(c("v01"), c("v01") + c("v00")).alias("false_positive_rate"), pct(c("m_fp"), c("m_neg")).alias("review_rate"),
        pct(c("v10"), fraud_v).alias("percentage_of_funds_lost"), pct(c("m_tp"), c("m_alerted")).alias("member_level_tpr"),
        pct(c("m_tp"), c("m_tp") + c("m_fn")).alias("member_level_recall"))


def prior_shift(df: DataFrame, label: str, weight: str, keys: list[str]) -> DataFrame:
    """Unweighted and weighted class prior per split and segment."""
    y, w = F.col(label).cast("double"), F.col(weight)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("prior"),
                                 F.try_divide(F.sum(y * w), F.sum(w)).alias("weighted_prior"))
