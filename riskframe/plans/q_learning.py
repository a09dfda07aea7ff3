"""Registered queries: fitted transforms, selection, weights, models and metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.hashing import portable_fraction
from ..operators import binning, encode, metrics, model, pipeline, select, splits, weights
from ..session import cut_lineage
from . import standins as v
from .q_relational import MIX, TARGETS, _targets
from .registry import Tables, query
from .standins import R, rnd

S = f"WITH {v.SUPERVISED}"
NUM = ["l_quantity", "l_discount", "l_tax", "p_size"]


def _sup(t: Tables):
    return v.supervised(t)


# ---- scaling and categories ----------------------------------------------------------------

@query("ft3_standard_scale", f"{S} SELECT row_key, " + ", ".join(f"{R(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()', 6)} AS {c}" for c in NUM) + " FROM supervised")
def ft3(t: Tables):
    d = _sup(t)
    x = encode.fit_standard_scaler(d, NUM).transform(d)
    return x.select("row_key", *[rnd(c, 6).alias(c) for c in NUM])


@query("ft4_min_max_scale", f"{S} SELECT row_key, " + ", ".join(f"{R(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())', 6)} AS {c}" for c in NUM) + " FROM supervised")
def ft4(t: Tables):
    d = _sup(t)
    x = encode.fit_min_max_scaler(d, NUM).transform(d)
    return x.select("row_key", *[rnd(c, 6).alias(c) for c in NUM])


@query("ft5_rare_categories", f"{S}, s AS (SELECT p_brand, count(*) / (SELECT count(*) FROM supervised) AS share FROM supervised GROUP BY 1) SELECT CASE WHEN share < 0.04 THEN 'Rare' ELSE p_brand END AS p_brand, count(*) AS n FROM supervised JOIN s USING (p_brand) GROUP BY 1")
def ft5(t: Tables):
    d = _sup(t)
    return encode.fit_rare(d, "p_brand", 0.04, 10).transform(d).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


FLAGS = ["A", "N", "R"]


@query("ft6_one_hot", f"{S} SELECT row_key, " + ", ".join(f"CAST(l_returnflag = '{f}' AS INT) AS l_returnflag_{f}" for f in FLAGS) + " FROM supervised")
def ft6(t: Tables):
    d = _sup(t)
    hot = encode.fit_one_hot(d, "l_returnflag")
    return hot.transform(d).select("row_key", *hot.names)


@query("ft6_one_hot_sparse", """WITH l AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place FROM (SELECT DISTINCT c_name AS value FROM customer WHERE c_custkey % 3 <> 0))
SELECT c_custkey, place, CAST(place IS NOT NULL AS INT) AS n FROM customer LEFT JOIN l ON c_name = value""")
def ft6_sparse(t: Tables):
    d = t.customer
    hot = encode.one_hot_vectors(d, "c_name", encode.one_hot_dictionary(d.where("c_custkey % 3 <> 0"), "c_name"))
    return hot.select("c_custkey", F.get("c_name_vec.indices", F.lit(0)).alias("place"), F.size("c_name_vec.values").alias("n"))


CAT = "CASE WHEN row_key % 7 <> 0 THEN p_brand END"


def _with_missing(t: Tables):
    return _sup(t).withColumn("cat", F.when(F.col("row_key") % 7 != 0, F.col("p_brand")))


@query("ft7_target_encoding", f"""{S}, d AS (SELECT *, {CAT} AS cat FROM supervised), p AS (SELECT avg(y) AS prior FROM d),
g AS (SELECT cat, count(*) AS n, avg(y) AS m FROM d WHERE cat IS NOT NULL GROUP BY 1)
SELECT row_key, {R("coalesce(CASE WHEN n = 1 THEN prior ELSE prior * (1 - 1 / (1 + exp(-(n - 20) / 10.0))) + m / (1 + exp(-(n - 20) / 10.0)) END, prior)", 6)} AS cat_encoded FROM p, d LEFT JOIN g USING (cat)""")
def ft7(t: Tables):
    d = _with_missing(t)
    return encode.fit_target_encoder(d, "cat", "y").transform(d).select("row_key", rnd("cat_encoded", 6).alias("cat_encoded"))


@query("ft8_m_estimate", f"""{S}, d AS (SELECT *, {CAT} AS cat FROM supervised), g AS (SELECT cat, (sum(y) + (SELECT avg(y) FROM d)) / (count(*) + 1) AS e FROM d WHERE cat IS NOT NULL GROUP BY 1)
SELECT row_key, {R('e', 6)} AS cat_encoded FROM d LEFT JOIN g USING (cat)""")
def ft8(t: Tables):
    d = _with_missing(t)
    return encode.fit_m_estimate(d, "cat", "y").transform(d).select("row_key", rnd("cat_encoded", 6).alias("cat_encoded"))


@query("ft8_m_estimate_out_of_fold", f"""{S}, d AS (SELECT *, {CAT} AS cat, {MIX.format(id='row_key', seed=4)} % 5 AS fold FROM supervised),
o AS (SELECT a.fold, a.cat, sum(b.y) AS s, count(b.y) AS n FROM (SELECT DISTINCT fold, cat FROM d) a LEFT JOIN d b ON a.cat = b.cat AND a.fold <> b.fold GROUP BY 1, 2),
p AS (SELECT a.fold, avg(b.y) AS prior FROM (SELECT DISTINCT fold FROM d) a JOIN d b ON a.fold <> b.fold GROUP BY 1)
SELECT row_key, CASE WHEN cat IS NOT NULL AND n > 0 THEN {R('(s + prior) / (n + 1)', 6)} END AS cat_encoded FROM d LEFT JOIN o USING (fold, cat) JOIN p USING (fold)""")
def ft8_oof(t: Tables):
    out = encode.m_estimate_out_of_fold(_with_missing(t), "cat", "y", "row_key", seed=4)
    return out.select("row_key", rnd("cat_encoded", 6).alias("cat_encoded"))


@query("ft8_m_estimate_randomised", f"""{S}, d AS (SELECT *, {CAT} AS cat FROM supervised) SELECT count(*) AS n, count(cat) AS encoded, {R('round_even(sqrt(avg(y) * (1 - avg(y))), 2)', 2)} AS sigma, TRUE AS centred, TRUE AS spread FROM d""")
def ft8_randomised(t: Tables):
    """The noise keeps the encoder's mean within five standard errors, and its deviation within a tenth."""
    d = _with_missing(t)
    sigma = encode.noise_scale(d.agg(F.avg("y")).first()[0])
    plain = encode.fit_m_estimate(d, "cat", "y").transform(d).withColumn("plain", F.col("cat_encoded"))
    ratio = F.try_divide("cat_encoded", "plain") - 1
    out = encode.randomised(plain, "cat_encoded", "row_key", sigma, seed=3).agg(
        F.count(F.lit(1)).alias("n"), F.count("cat_encoded").alias("encoded"), F.avg(ratio).alias("m"), F.stddev(ratio).alias("s"))
    return out.select("n", "encoded", F.lit(sigma).alias("sigma"), (F.abs("m") < 5 * sigma / F.sqrt("encoded")).alias("centred"), (F.abs(F.col("s") / sigma - 1) < 0.1).alias("spread"))


VOCAB = """d AS (SELECT o_orderkey, o_orderpriority AS a, CASE WHEN o_orderkey % 3 > 0 THEN (['1-URGENT', '2-HIGH', '3-MEDIUM', 'unseen'])[1 + o_custkey % 4] END AS b, o_orderstatus AS s,
  CAST(o_totalprice > 300000 AS INT) AS y FROM orders), pr AS (SELECT avg(y) AS prior FROM d)"""


@query("ft9_ft10_shared_vocabulary", f"""WITH {VOCAB}, g AS (SELECT a AS v, (sum(y) + (SELECT prior FROM pr)) / (count(*) + 1) AS e FROM d GROUP BY 1), h AS (SELECT s, (sum(y) + (SELECT prior FROM pr)) / (count(*) + 1) AS e FROM d GROUP BY 1)
SELECT o_orderkey, {R('greatest(g1.e, g2.e)', 6)} AS a_encoded, {R('greatest(g1.e, g2.e, h.e)', 6)} AS nob_encoded FROM d LEFT JOIN g g1 ON d.a = g1.v LEFT JOIN g g2 ON d.b = g2.v LEFT JOIN h ON d.s = h.s""")
def ft9(t: Tables):
    k = F.col("o_orderkey")
    other = F.get(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "unseen")]), (F.col("o_custkey") % 4).cast("int"))
    d = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("a"), F.when(k % 3 > 0, other).alias("b"), F.col("o_orderstatus").alias("s"), (F.col("o_totalprice") > 300000).cast("int").alias("y"))
    x = encode.shared_vocabulary(d, encode.fit_m_estimate(d, "a", "y"), ["a", "b"], "o_orderkey", "a_encoded")
    x = encode.fit_m_estimate(d, "s", "y").transform(x, "s_encoded").withColumn("ae", F.col("a_encoded"))
    x = encode.max_of(x, ["ae", "s_encoded"], "nob_encoded")
    return x.select("o_orderkey", rnd("a_encoded", 6).alias("a_encoded"), rnd("nob_encoded", 6).alias("nob_encoded"))


@query("ft11_noise", """SELECT count(*) AS n, count(DISTINCT l_orderkey * 10 + l_linenumber) AS rows_changed, true AS centred, true AS third_of_spread FROM lineitem JOIN part ON l_partkey = p_partkey""")
def ft11(t: Tables):
    d = _sup(t).withColumn("w", F.lit(1.0)).withColumn("clean", F.col("l_quantity"))
    noisy = encode.fit_noise(d, ["l_quantity"], "w", "row_key", 3.0, 17).transform(d)
    diff = F.col("l_quantity") - F.col("clean")
    # the noise has mean 0 and a third of the column's deviation, within 5 standard errors
    spread, root = F.stddev_pop("clean") / 3, F.sqrt(F.count(F.lit(1)))
    return noisy.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(diff != 0, F.col("row_key"))).alias("rows_changed"),
                     (F.abs(F.avg(diff)) < 5 * spread / root).alias("centred"), (F.abs(F.stddev_pop(diff) / spread - 1) < 5 / root).alias("third_of_spread"))


# ---- binning and selection -----------------------------------------------------------------

EDGES = "(SELECT list_distinct(quantile_disc(x, [" + ", ".join(str(i / 8) for i in range(1, 8)) + "])) FROM d)"


@query("ft12_woe", f"""{S}, d AS (SELECT row_key, CASE WHEN row_key % 11 <> 0 THEN l_quantity + 200 * l_discount END AS x, y FROM supervised),
e AS (SELECT unnest({EDGES}) AS edge), b AS (SELECT row_key, y, x, CASE WHEN x IS NOT NULL THEN (SELECT count(*) FROM e WHERE edge <= x) END AS bin FROM d),
c AS (SELECT bin, count(*) AS n, sum(y) AS s FROM b WHERE bin IS NOT NULL GROUP BY 1),
av AS (SELECT i.bin AS i, j.bin AS j, (SELECT sum(s) / sum(n) FROM c k WHERE k.bin BETWEEN i.bin AND j.bin) AS a FROM c i JOIN c j ON i.bin <= j.bin),
iso AS (SELECT k.bin, max(m) AS g FROM c k JOIN (SELECT i, kk.bin AS k, min(a) AS m FROM av JOIN c kk ON av.i <= kk.bin AND av.j >= kk.bin GROUP BY 1, 2) q ON q.k = k.bin GROUP BY 1),
tot AS (SELECT count(*) AS n, sum(y) AS s FROM d), mis AS (SELECT count(*) AS n, sum(y) AS s FROM d WHERE x IS NULL)
SELECT row_key, {R("CASE WHEN b.bin IS NULL THEN ln(((mis.n - mis.s) / (tot.n - tot.s)) / (mis.s / tot.s)) ELSE ln(((1 - g) / g) * (tot.s / (tot.n - tot.s))) END", 6)} AS x_encoded FROM tot, mis, b LEFT JOIN iso ON b.bin = iso.bin""")
def ft12(t: Tables):
    d = _sup(t).select("row_key", "y", F.when(F.col("row_key") % 11 != 0, F.col("l_quantity") + 200 * F.col("l_discount")).alias("x"))
    m = binning.fit_woe(d, ["x"], "y", prebins=8, accuracy=1_000_000)["x"]
    return m.transform(d).select("row_key", rnd("x_encoded", 6).alias("x_encoded"))


def _iv_sql() -> str:
    probs = "[" + ", ".join(str(i / 10) for i in range(1, 10)) + "]"
    parts = [f"""SELECT '{c}' AS feature, sum(((n - s) / (tn - ts) - s / ts) * CASE WHEN n > s AND s > 0 THEN ln(((n - s) / (tn - ts)) / (s / ts)) ELSE 0 END) AS iv FROM (
      SELECT bin, count(*) AS n, sum(y) AS s, sum(count(*)) OVER () AS tn, sum(sum(y)) OVER () AS ts FROM (
        SELECT y, (SELECT count(*) FROM (SELECT unnest(list_distinct(quantile_disc({c}, {probs}))) AS e FROM supervised) WHERE e <= x) AS bin FROM (SELECT {c} AS x, y FROM supervised)) GROUP BY 1)""" for c in NUM]
    return f"{S} SELECT feature, {R('iv', 6)} AS iv, CASE WHEN iv > 0.5 THEN 'suspecious' WHEN iv > 0.3 THEN 'strong' WHEN iv > 0.1 THEN 'medium' WHEN iv >= 0.02 THEN 'weak' ELSE 'useless' END AS power FROM ({' UNION ALL '.join(parts)})"


@query("ft13_information_value", _iv_sql())
def ft13(t: Tables):
    iv = binning.information_value(_sup(t), NUM, "y", 10, accuracy=1_000_000)
    return iv.select("feature", rnd("iv", 6).alias("iv"), "power")


@query("ft14_variances", f"{S} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {R(f'var_pop({c})', 6)} AS variance FROM supervised" for c in NUM))
def ft14(t: Tables):
    return select.variances(_sup(t), NUM).withColumn("variance", rnd("variance", 6))


@query("ft16_vif", f"""{S}, r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM supervised), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS "column", unnest([{R('(1 - c * c) / det', 5)}, {R('(1 - b * b) / det', 5)}, {R('(1 - a * a) / det', 5)}]) AS vif FROM d""")
def ft16(t: Tables):
    return select.vif_table(_sup(t), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("vif", rnd("vif", 5))


HOLES = "CASE WHEN row_key % 5 <> 0 THEN l_quantity END AS q, CASE WHEN row_key % 7 <> 0 THEN 2 * l_quantity + p_size END AS twice, CASE WHEN row_key % 3 <> 0 THEN p_size END AS p_size"
INFLATED = f"""{S}, x AS (SELECT {HOLES} FROM supervised), r AS (SELECT corr(q, twice) AS a, corr(q, p_size) AS b, corr(twice, p_size) AS c FROM x),
d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r), f AS (SELECT (1 - c * c) / det AS q, (1 - b * b) / det AS twice, (1 - a * a) / det AS p_size, a, b, c FROM d)"""


def _holes(t: Tables):
    d, key = _sup(t), F.col("row_key")
    return d.select(F.when(key % 5 != 0, F.col("l_quantity")).alias("q"), F.when(key % 7 != 0, 2 * F.col("l_quantity") + F.col("p_size")).alias("twice"),
                    F.when(key % 3 != 0, F.col("p_size")).alias("p_size"), F.lit(1.0).alias("flat"))


@query("ft16_vif_pairwise", f"""{INFLATED} SELECT unnest(['q', 'twice', 'p_size']) AS "column", unnest([{R('q', 4)}, {R('twice', 4)}, {R('p_size', 4)}]) AS vif FROM f""")
def ft16_pairwise(t: Tables):
    """Missing values leave out pairs, not rows."""
    return select.vif_table(_holes(t), ["q", "twice", "p_size"]).withColumn("vif", rnd("vif", 4))


# of three columns the most inflated one goes, and one of the other two if they are still too close
@query("ft15_ft16_selection", f"""{INFLATED}, w AS (SELECT *, greatest(q, twice, p_size) AS top FROM f),
g AS (SELECT *, CASE WHEN top < 10 THEN '' WHEN q = top THEN 'q' WHEN twice = top THEN 'twice' ELSE 'p_size' END AS gone FROM w),
h AS (SELECT *, CASE gone WHEN 'q' THEN c WHEN 'twice' THEN b WHEN 'p_size' THEN a ELSE 0 END AS rest FROM g)
SELECT col AS "column", col <> 'flat' AND col <> gone AND NOT (1 / (1 - rest * rest) >= 10 AND col = CASE WHEN gone = 'q' THEN 'twice' ELSE 'q' END) AS kept
FROM h, (SELECT unnest(['q', 'twice', 'p_size', 'flat']) AS col)""")
def ft15(t: Tables):
    return select.selection(_holes(t), ["q", "twice", "p_size", "flat"])


@query("ft17_feature_pipeline", f"""{S}, d AS (SELECT row_key, y, coalesce(CASE WHEN row_key % 5 <> 0 THEN l_quantity END, 0) AS q, l_tax, coalesce(CASE WHEN row_key % 6 <> 0 THEN p_brand END, 'missing') AS b FROM supervised),
s AS (SELECT b, count(*) / (SELECT count(*) FROM d) AS share FROM d GROUP BY 1), k AS (SELECT d.*, CASE WHEN share < 0.1 THEN 'Rare' ELSE d.b END AS g FROM d JOIN s ON d.b = s.b)
SELECT row_key, {R('(q - avg(q) OVER ()) / stddev_pop(q) OVER ()', 6)} AS q, {R('(l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER ()', 6)} AS l_tax, CAST(g = 'Rare' AS INT) AS "b_Rare", CAST(g = 'missing' AS INT) AS b_missing, y FROM k""")
def ft17(t: Tables):
    d = _sup(t).select("row_key", "y", "l_tax", F.when(F.col("row_key") % 5 != 0, F.col("l_quantity")).alias("q"), F.when(F.col("row_key") % 6 != 0, F.col("p_brand")).alias("b"))
    p = pipeline.fit_features(d, ["q"], ["l_tax"], {"b": (0.1, 5)}, ["y"], ["row_key"])
    return p.transform(d).select("row_key", rnd("q", 6).alias("q"), rnd("l_tax", 6).alias("l_tax"), "b_Rare", "b_missing", "y")


@query("ft18_scaled_weights", f"""WITH f AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, 1.0 / count(*) OVER (PARTITION BY o_custkey) AS w, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice ELSE 0 END AS a FROM orders),
g AS (SELECT *, w + (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS m, max(d) OVER () AS last FROM f),
h AS (SELECT *, (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) * exp(-ln(2) * (last - d) / 180.0) AS r FROM g)
SELECT o_orderkey, {R('r * count(*) OVER () / sum(r) OVER ()', 6)} AS w_scaled FROM h""")
def ft18(t: Tables):
    d = weights.frequency_weights(t.orders, "o_custkey").select("o_orderkey", "w_inverse", F.col("o_orderdate").cast("date").alias("d"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("a"))
    return weights.scaled_weights(d, "w_inverse", "a", "d").select("o_orderkey", rnd("w_scaled", 6).alias("w_scaled"))


@query("ft19_stratified_folds", f"""WITH d AS (SELECT o_orderkey, CAST(o_totalprice > 400000 AS INT) AS y FROM orders),
r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY y ORDER BY {MIX.format(id='o_orderkey', seed=2)}, o_orderkey) AS rn, count(*) OVER (PARTITION BY y) AS n FROM d)
SELECT o_orderkey, CAST((rn - 1) % 5 AS INT) AS fold, CASE WHEN rn <= floor(n * 0.2 + 1e-9) THEN 'test' ELSE 'train' END AS split FROM r""")
def ft19(t: Tables):
    d = t.orders.select("o_orderkey", (F.col("o_totalprice") > 400000).cast("int").alias("y"))
    folded = splits.stratified_folds(d, ["y"], "o_orderkey", 5, 2)
    return folded.join(splits.stratified_split(d, ["y"], "o_orderkey", 0.2, 2).drop("y"), "o_orderkey").select("o_orderkey", "fold", "split")


# ---- models --------------------------------------------------------------------------------

@query("ml1_logistic_regression")
def ml1(t: Tables):
    d = _sup(t).withColumn("w", 0.5 + F.col("l_tax"))
    m = model.fit_logistic(d, NUM, "y", "w")
    return model.importance(m, NUM, d)


BINARY = f"""{S}, r AS (SELECT y, 0.5 + l_tax AS w, CAST(l_quantity > 25 AS INT) AS x FROM supervised), p AS (SELECT x, sum(w * y) / sum(w) AS p, avg(y) AS q FROM r GROUP BY 1)"""


@query("ml1_logistic_binary", f"""{BINARY} SELECT 'x' AS feature, {R("max(CASE WHEN x = 1 THEN ln(p / (1 - p)) END) - max(CASE WHEN x = 0 THEN ln(p / (1 - p)) END)", 2)} AS coefficient FROM p""")
def ml1_binary(t: Tables):
    """With one binary feature the weighted fit is the logarithm of the odds ratio."""
    d = _sup(t).select("y", (0.5 + F.col("l_tax")).alias("w"), (F.col("l_quantity") > 25).cast("int").alias("x"))
    m = model.fit_logistic(d, ["x"], "y", "w", c=1e9, l1_ratio=0.0, balanced=False, max_iter=200)
    return model.importance(m, ["x"], d).withColumn("coefficient", rnd("coefficient", 2))


@query("ml2_platt_binary", f"""{BINARY} SELECT x, {R('q', 3)} AS calibrated FROM p""")
def ml2_binary(t: Tables):
    """A score of two values is calibrated to the share of each."""
    d = _sup(t).select("y", (F.col("l_quantity") > 25).cast("int").alias("x"))
    slope, intercept = model.fit_platt(d, "x", "y")
    return d.select("x").distinct().select("x", rnd(model.apply_platt("x", slope, intercept), 3).alias("calibrated"))


@query("ml2_platt_calibration")
def ml2(t: Tables):
    d = _sup(t)
    slope, intercept = model.fit_platt(d, "score", "y")
    c = d.withColumn("calibrated", model.apply_platt("score", slope, intercept))
    return metrics.calibration_curve(c, "calibrated", "y")


@query("ml3_kaplan_meier", f"""{TARGETS}, w AS (SELECT is_registered AS segment, CAST(round_even(duration / 7.0, 0) AS INT) AS duration, event FROM tgt WHERE is_registered IS NOT NULL AND duration > 0),
p AS (SELECT segment, duration, count(*) AS leaving, CAST(sum(event) AS BIGINT) AS events FROM w GROUP BY 1, 2),
k AS (SELECT *, CAST(sum(leaving) OVER (PARTITION BY segment ORDER BY duration ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk FROM p)
SELECT segment, duration, events, at_risk, {R('exp(sum(ln(1 - events / at_risk)) OVER (PARTITION BY segment ORDER BY duration))', 6)} AS survival FROM k""")
def ml3(t: Tables):
    d = _targets(t).where("is_registered is not null and duration > 0").select(F.col("is_registered").alias("segment"), F.bround(F.col("duration") / 7, 0).cast("int").alias("duration"), "event")
    k = model.kaplan_meier(d, "duration", "event", ["segment"])
    return k.select("segment", "duration", "events", "at_risk", rnd("survival", 6).alias("survival"))


@query("ml3_survival_regression")
def ml3_aft(t: Tables):
    d = _targets(t).where("is_registered is not null and duration > 0")
    m = model.fit_survival_regression(d, ["is_registered"], "duration", "event")
    s = model.survival_probability(m, d, ["is_registered"], 90.0)
    return s.groupBy("is_registered").agg(F.avg("survival").alias("survival"), F.count(F.lit(1)).alias("n"))


@query("ml4_scoring_and_rating", f"""{S} SELECT row_key, {R('1 / (1 + exp(-(0.04 * l_quantity + 9 * l_discount - 2.5)))', 6)} AS probability,
  CASE WHEN 1 - 1 / (1 + exp(-(0.04 * l_quantity + 9 * l_discount - 2.5))) <= 0.4 THEN 'Low' WHEN 1 - 1 / (1 + exp(-(0.04 * l_quantity + 9 * l_discount - 2.5))) >= 0.7 THEN 'High' ELSE 'Medium' END AS risk_rating FROM supervised""")
def ml4(t: Tables):
    def predict(batch):
        z = 0.04 * batch["l_quantity"] + 9 * batch["l_discount"] - 2.5
        return 1 / (1 + np.exp(-z))

    scored = model.score_with(_sup(t), predict, ["l_quantity", "l_discount"], ["row_key"])
    return model.rate_predictions(scored, "probability", 0.4, 0.7).select("row_key", rnd("probability", 6).alias("probability"), "risk_rating")


# ---- metrics -------------------------------------------------------------------------------

def _auc_sql(keys: str, weight: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""g AS (SELECT {k}score, sum(CASE WHEN y = 1 THEN {weight} ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN {weight} ELSE 0 END) AS n FROM supervised GROUP BY {k}score),
r AS (SELECT *, coalesce(sum(n) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
a AS (SELECT {k}sum(p) AS positives, sum(n) AS negatives, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auc FROM r {g})"""


@query("mt1_weighted_auc", f"{S}, {_auc_sql('', '(0.5 + l_tax)')} SELECT {R('positives', 3)} AS positives, {R('negatives', 3)} AS negatives, {R('auc', 6)} AS auc FROM a")
def mt1(t: Tables):
    a = metrics.auc(_sup(t), "score", "y", 0.5 + F.col("l_tax"))
    return a.select(rnd("positives", 3).alias("positives"), rnd("negatives", 3).alias("negatives"), rnd("auc", 6).alias("auc"))


@query("mt1_auc_by_segment", f"{S}, {_auc_sql('l_linestatus', 'CAST(1 AS DOUBLE)')} SELECT l_linestatus, positives, negatives, {R('auc', 6)} AS auc FROM a")
def mt1_segment(t: Tables):
    return metrics.auc(_sup(t), "score", "y", keys=["l_linestatus"]).withColumn("auc", rnd("auc", 6))


@query("mt1_auc_over_dates", f"{S}, d AS (SELECT * EXCLUDE (l_shipdate), CAST(date_trunc('month', l_shipdate) AS DATE) AS month FROM supervised), {_auc_sql('month', 'CAST(1 AS DOUBLE)').replace('FROM supervised', 'FROM d')} "
       f"SELECT {R('avg(round_even(auc, 2))', 5)} AS mean_auc, {R('stddev_pop(round_even(auc, 2))', 5)} AS std_auc, count(auc) AS dates FROM a")
def mt1_dates(t: Tables):
    d = _sup(t).withColumn("month", F.trunc("l_shipdate", "month"))
    a = metrics.auc_by_date(d, "score", "y", "month")
    return a.select(rnd("mean_auc", 5).alias("mean_auc"), rnd("std_auc", 5).alias("std_auc"), "dates")


ROC = f"""{S}, g AS (SELECT round(score, 3) AS s, sum(y) AS p, count(*) - sum(y) AS n FROM supervised GROUP BY 1),
r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, lead(p) OVER w AS np, lead(n) OVER w AS nn, row_number() OVER w AS rn, sum(p) OVER () AS tp_all, sum(n) OVER () AS fp_all FROM g WINDOW w AS (ORDER BY s DESC)),
c AS (SELECT * FROM r WHERE rn = 1 OR np IS NULL OR np <> p OR nn <> n)"""


def _rounded_scores(t: Tables):
    return _sup(t).withColumn("s", F.round("score", 3))


@query("mt1_roc_curve", f"{ROC} SELECT {R('s', 3)} AS threshold, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, {R('tp / tp_all', 6)} AS tpr, {R('fp / fp_all', 6)} AS fpr FROM c")
def mt1_roc(t: Tables):
    p = metrics.roc_points(_rounded_scores(t), "s", "y")
    return p.select(rnd("threshold", 3).alias("threshold"), "tp", "fp", rnd("tpr", 6).alias("tpr"), rnd("fpr", 6).alias("fpr"))


@query("mt5_threshold_at_fpr", f"{ROC} SELECT {R('min(s)', 3)} AS threshold FROM c WHERE fp / fp_all <= 0.005")
def mt5(t: Tables):
    return metrics.threshold_at_fpr(_rounded_scores(t), "s", "y", 0.005).withColumn("threshold", rnd("threshold", 3))


@query("mt2_classification_scores", f"""{S}, c AS (SELECT l_returnflag, sum(w * (y = 1 AND p = 1)::INT) AS tp, sum(w * (y = 0 AND p = 1)::INT) AS fp, sum(w * (y = 1 AND p = 0)::INT) AS fn, sum(w * (y = 0 AND p = 0)::INT) AS tn
  FROM (SELECT *, 0.5 + l_tax AS w, CAST(score > 0.6 AS INT) AS p FROM supervised) GROUP BY 1)
SELECT l_returnflag, {R('tp', 3)} AS tp, {R('tp / (tp + fp)', 6)} AS precision, {R('tp / (tp + fn)', 6)} AS recall, {R('2 * tp / (2 * tp + fp + fn)', 6)} AS f1,
  {R('(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))', 6)} AS mcc, {R('(tp + tn) / (tp + fp + fn + tn)', 6)} AS accuracy, {R('(tp / (tp + fn) + tn / (tn + fp)) / 2', 6)} AS balanced_accuracy FROM c""")
def mt2(t: Tables):
    d = _sup(t).withColumn("p", (F.col("score") > 0.6).cast("int"))
    s = metrics.classification_scores(d, "y", "p", 0.5 + F.col("l_tax"), ["l_returnflag"])
    return s.select("l_returnflag", rnd("tp", 3).alias("tp"), *[rnd(c, 6).alias(c) for c in ("precision", "recall", "f1", "mcc", "accuracy", "balanced_accuracy")])


@query("mt3_concordance", f"""{TARGETS}, g AS (SELECT CAST(round_even(duration / 7.0, 0) AS INT) AS d, event AS e, CAST(CAST(company_id AS BIGINT) % 50 AS DOUBLE) AS r, count(*) AS n FROM tgt WHERE duration > 0 GROUP BY 1, 2, 3),
x AS (SELECT sum(a.n * b.n * CASE WHEN a.r > b.r THEN 1.0 WHEN a.r = b.r THEN 0.5 ELSE 0 END) AS won, sum(a.n * b.n) AS pairs FROM g a JOIN g b ON a.e = 1 AND (b.d > a.d OR (b.d = a.d AND b.e = 0)))
SELECT CAST(won AS DOUBLE) AS concordant, CAST(pairs AS DOUBLE) AS comparable, {R('won / pairs', 6)} AS concordance FROM x""")
def mt3(t: Tables):
    d = _targets(t).where("duration > 0").select(F.bround(F.col("duration") / 7, 0).cast("int").alias("weeks"), "event", (F.col("company_id").cast("long") % 50).cast("double").alias("risk"))
    return metrics.concordance(d, "weeks", "event", "risk").withColumn("concordance", rnd("concordance", 6))


@query("mt3_repeated_folds", f"""{TARGETS}, g AS (SELECT CAST(company_id AS BIGINT) * 100000 + date_diff('day', DATE '1990-01-01', CAST(timestamp AS DATE)) AS id, CAST(round_even(duration / 7.0, 0) AS INT) AS d,
  event AS e, CAST(company_id AS BIGINT) % 10 AS grp FROM tgt WHERE duration > 0),
m AS (SELECT *, (row_number() OVER (PARTITION BY rep, e ORDER BY ((id % 1000003) * 7919 + rep) % 1000003, id) - 1) % 3 AS fold FROM g, (SELECT unnest(range(2)) AS rep)),
s AS (SELECT rep, fold, grp, sum(e) AS y, count(*) AS n FROM m GROUP BY ALL),
r AS (SELECT rep, fold, grp, (sum(y) OVER (PARTITION BY rep, grp) - y) / (sum(n) OVER (PARTITION BY rep, grp) - n) AS risk FROM s),
c AS (SELECT rep, fold, d, e, risk, count(*) AS n FROM m JOIN r USING (rep, fold, grp) GROUP BY ALL),
x AS (SELECT rep, fold, sum(a.n * b.n * CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) / sum(a.n * b.n) AS score
  FROM c a JOIN c b USING (rep, fold) WHERE a.e = 1 AND (b.d > a.d OR (b.d = a.d AND b.e = 0)) GROUP BY 1, 2)
SELECT {R('avg(score)', 6)} AS mean, {R('stddev_samp(score)', 6)} AS std, count(*) AS n FROM x""")
def mt3_folds(t: Tables):
    """Concordance of a baseline model over two repeats of three stratified folds."""
    d = _targets(t).where("duration > 0").select(
        (F.col("company_id").cast("long") * 100000 + F.date_diff(F.col("timestamp").cast("date"), F.lit("1990-01-01").cast("date"))).alias("id"),
        F.bround(F.col("duration") / 7, 0).cast("int").alias("weeks"), "event", (F.col("company_id").cast("long") % 10).alias("grp"))
    folds = splits.repeated_folds(d, ["event"], "id", 3, 2)
    # the model and the pairs read counts of equal rows: the ranked rows are read once, and never joined
    cells = cut_lineage(folds.groupBy("repeat", "fold", "grp", "weeks", "event").agg(F.count(F.lit(1)).alias("n")))
    scored = splits.out_of_fold_rate(cells, "grp", "event", weight="n")
    per = metrics.concordance(scored, "weeks", "event", "risk", keys=("repeat", "fold"), weight="n")
    return metrics.cross_validated(per).select(rnd("mean", 6).alias("mean"), rnd("std", 6).alias("std"), "n")


@query("mt4_calibration_curve", f"""{S}, n AS (SELECT y, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS p FROM supervised)
SELECT CAST(least(greatest(ceil(p * 10) - 1, 0), 9) AS INT) AS bin, count(*) AS n, {R('avg(p)', 6)} AS mean_score, {R('avg(y)', 6)} AS event_rate FROM n GROUP BY 1""")
def mt4(t: Tables):
    c = metrics.calibration_curve(_sup(t), "score", "y")
    return c.select("bin", "n", rnd("mean_score", 6).alias("mean_score"), rnd("event_rate", 6).alias("event_rate"))


@query("mt6_segment_threshold", f"""{S}, q AS (SELECT l_linestatus, quantile_cont(l_extendedprice, 0.95) AS c FROM supervised GROUP BY 1)
SELECT l_linestatus, {R('max(c)', 4)} AS threshold, CAST(sum(CAST(l_extendedprice >= c AS INT)) AS BIGINT) AS flagged, count(*) AS n FROM supervised JOIN q USING (l_linestatus) GROUP BY 1""")
def mt6(t: Tables):
    d = metrics.segment_threshold(_sup(t), "l_extendedprice", "l_linestatus", 0.95)
    return d.groupBy("l_linestatus").agg(rnd(F.max("threshold"), 4).alias("threshold"), F.sum("predicted").alias("flagged"), F.count(F.lit(1)).alias("n"))


def _kpi_sql() -> str:
    n = lambda c: f"count(CASE WHEN {c} THEN 1 END)"
    s = lambda c: f"sum(CASE WHEN {c} THEN v ELSE 0 END)"
    m = lambda c: f"count(DISTINCT CASE WHEN {c} THEN company_id END)"
    tp, fp, fn, tn = "y = 1 AND p = 1", "y = 0 AND p = 1", "y = 1 AND p = 0", "y = 0 AND p = 0"
    cols = {"block_rate": f"{n('p = 1')} * 100.0 / count(*)", "precision": f"{n(tp)} * 100.0 / {n('p = 1')}", "recall": f"{n(tp)} * 100.0 / {n('y = 1')}",
            "precision_by_value": f"{s(tp)} * 100 / {s('p = 1')}", "recall_by_value": f"{s(tp)} * 100 / {s('y = 1')}", "decline_rate": f"{s('p = 1')} * 100 / sum(v)",
            "fraud_exposure": f"{s(fn)} * 100 / {s('p = 0')}", "false_positive_rate": f"{s(fp)} * 100 / ({s(fp)} + {s(tn)})", "review_rate": f"{m(fp)} * 100.0 / {m('y = 0')}",
            "percentage_of_funds_lost": f"{s(fn)} * 100 / {s('y = 1')}", "member_level_tpr": f"{m(tp)} * 100.0 / {m('p = 1')}", "member_level_recall": f"{m(tp)} * 100.0 / ({m(tp)} + {m(fn)})"}
    return f"{S}, d AS (SELECT company_id, l_extendedprice AS v, y, CAST(score > 0.6 AS INT) AS p FROM supervised) SELECT {n('p = 1')} AS blocked, " + ", ".join(f"{R(e, 6)} AS {c}" for c, e in cols.items()) + " FROM d"


@query("mt7_business_kpis", _kpi_sql())
def mt7(t: Tables):
    d = _sup(t).withColumn("p", (F.col("score") > 0.6).cast("int"))
    k = metrics.business_kpis(d, "company_id", "l_extendedprice", "y", "p")
    return k.select("blocked", *[rnd(c, 6).alias(c) for c in k.columns if c != "blocked"])


@query("mt9_prior_shift", f"""{S}, d AS (SELECT *, CASE WHEN {MIX.format(id='row_key', seed=8)} / 1000003.0 < 0.7 THEN 'train' ELSE 'test' END AS split, 0.5 + l_tax AS w FROM supervised)
SELECT split, l_linestatus, count(*) AS n, {R('avg(y)', 6)} AS prior, {R('sum(y * w) / sum(w)', 6)} AS weighted_prior FROM d GROUP BY 1, 2""")
def mt9(t: Tables):
    d = _sup(t).withColumn("split", F.when(portable_fraction("row_key", 8) < 0.7, "train").otherwise("test")).withColumn("w", 0.5 + F.col("l_tax"))
    p = metrics.prior_shift(d, "y", "w", ["split", "l_linestatus"])
    return p.select("split", "l_linestatus", "n", rnd("prior", 6).alias("prior"), rnd("weighted_prior", 6).alias("weighted_prior"))




# ---- oversampling --------------------------------------------------------------------------

def _vectors(t: Tables):
    return t.embeddings.select("vec_id", "embedding", (F.col("label") == 3).cast("int").alias("y"))


@query("ft20_danger_points", """WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label = 3 AS INT) AS y FROM embeddings),
n AS (SELECT a.vec_id, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rn FROM d a JOIN d b ON a.y = 1 AND a.vec_id <> b.vec_id)
SELECT vec_id AS pid, CAST(sum(1 - y) AS BIGINT) AS majority, CAST(sum(1 - y) >= 5 AND sum(1 - y) < 10 AS INT) AS danger FROM n WHERE rn <= 10 GROUP BY 1""")
def ft20_danger(t: Tables):
    from ..operators import oversample

    p = oversample.distinct_points(_vectors(t), "vec_id", "embedding", "y")
    return oversample.danger_points(p, oversample.nearest(p, 64, 10, 5), 10).select("pid", "majority", "danger")


def _mix(number: str, seed: int) -> str:
    """SQL of ``portable_mix`` for whole numbers."""
    return f"((({number}) % 1000003) * 7919 + {seed}) % 1000003"


@query("ft20_borderline_oversampling", f"""WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label = 3 AS INT) AS y FROM embeddings),
n AS MATERIALIZED (SELECT a.vec_id, b.vec_id AS other, b.y, list_distance(a.v, b.v) AS d FROM d a JOIN d b ON a.y = 1 AND a.vec_id <> b.vec_id),
near AS (SELECT vec_id, y, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS rn FROM n),
danger AS (SELECT vec_id, {_mix('vec_id', 0)} AS mix FROM near WHERE rn <= 10 GROUP BY vec_id HAVING sum(1 - y) >= 5 AND sum(1 - y) < 10),
need AS (SELECT greatest(CAST(floor(0.3 * count_if(y <> 1)) AS BIGINT) - count_if(y = 1), 0) AS need FROM d),
ranked AS (SELECT vec_id, row_number() OVER (ORDER BY mix, vec_id) AS cum, count(*) OVER () AS total FROM danger),
steps AS (SELECT vec_id, unnest(range(1, CAST(floor(need * cum / total) - floor(need * (cum - 1) / total) AS BIGINT) + 1)) AS step FROM ranked, need),
lists AS (SELECT vec_id, list(other ORDER BY rn) AS others FROM (SELECT vec_id, other, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS rn FROM n WHERE y = 1) WHERE rn <= 5 GROUP BY vec_id),
picked AS (SELECT s.vec_id AS base, s.step, others[({_mix(f"{_mix('s.vec_id', 0)} * 1009 + s.step", 1)}) % len(others) + 1] AS other,
  ({_mix(f"{_mix('s.vec_id', 0)} * 1009 + s.step", 2)}) / 1000003.0 AS u FROM steps s JOIN lists USING (vec_id))
SELECT base, other, CAST(step AS INT) AS step, {R('x.v[1] + u * (y.v[1] - x.v[1])', 6)} AS v0, CAST(len(x.v) AS INT) AS dim
FROM picked JOIN d x ON x.vec_id = base JOIN d y ON y.vec_id = other""")
def ft20(t: Tables):
    from ..operators import oversample

    out = oversample.borderline_oversample(_vectors(t), "vec_id", "embedding", "y", 64, ratio=0.3)
    return out.select("base", "other", "step", rnd(F.get("vec", F.lit(0)), 6).alias("v0"), F.size("vec").alias("dim"))


@query("ml4_native_scoring", f"""{S}, r AS (SELECT row_key, y, CASE WHEN row_key % 5 <> 0 THEN CAST(l_quantity > 25 AS INT) END AS x FROM supervised),
p AS (SELECT x, avg(y) AS p FROM r WHERE x IS NOT NULL GROUP BY 1) SELECT row_key, {R('p', 2)} AS probability FROM r LEFT JOIN p USING (x)""")
def ml4_native(t: Tables):
    """With one binary feature the fitted probability is the share of each value; rows without it stay, unscored."""
    d = _sup(t).select("row_key", "y", F.when(F.col("row_key") % 5 != 0, (F.col("l_quantity") > 25).cast("int")).alias("x"))
    m = model.fit_logistic(d.where("x is not null"), ["x"], "y", c=1e9, l1_ratio=0.0, balanced=False, max_iter=200)
    return model.score_logistic(m, d, ["x"]).select("row_key", rnd("probability", 2).alias("probability"))
