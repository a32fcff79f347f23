"""Label, split, imputation, calibration and metric queries (I1-I8, F8, F9, F11-F15, H7/H8)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.constants import CLOSE_DATE, KEY_MCT, KEY_YM, NUM_FEATURES
from storewatch.operators.ensemble import calibrate_lstsq, weighted_ensemble
from storewatch.operators.labels import (class_summary, closure_label, label_base, label_cascade, nlargest_label,
                                         proxy_label, proxy_label_any, stratified_split, topq_label)
from storewatch.operators.metrics import average_precision, fit_medians, roc_auc
from storewatch.plans.catalog import panel, r6, register, scored
from storewatch.plans.oracle_panel import panel_ctes
from storewatch.plans.oracle_risk import scored_ctes
from storewatch.sources.tables import Tables


def _closure(spark, sf):
    p = panel(spark, sf)
    return closure_label(label_base(p.usage, p.customers), p.merchants)


def _proxy_base(spark, sf):
    p = panel(spark, sf, cancel_form="number")
    return label_base(p.usage, p.customers)


_LB = """lb AS (SELECT COALESCE(u.ENCODED_MCT, c.ENCODED_MCT) AS ENCODED_MCT,
  CAST(strptime(COALESCE(u.TA_YM, c.TA_YM), '%Y%m') AS DATE) AS TA_YM, u.* EXCLUDE (ENCODED_MCT, TA_YM),
  c.* EXCLUDE (ENCODED_MCT, TA_YM)
  FROM ds2 u FULL OUTER JOIN ds3 c ON u.ENCODED_MCT = c.ENCODED_MCT AND u.TA_YM = c.TA_YM)"""
_CL = """cl AS (SELECT lb.*, m.MCT_ME_D, CASE WHEN m.MCT_ME_D IS NOT NULL AND m.MCT_ME_D > lb.TA_YM
  AND m.MCT_ME_D <= CAST(last_day(lb.TA_YM) + INTERVAL 3 MONTH AS DATE) THEN 1 ELSE 0 END AS y
  FROM lb LEFT JOIN ds1 m ON lb.ENCODED_MCT = m.ENCODED_MCT)"""
_PX = """px AS (SELECT *, saa - LAG(saa) OVER w AS dSAA, cus - LAG(cus) OVER w AS dCUS FROM (
  SELECT ENCODED_MCT, TA_YM, TRY_CAST(NULLIF(regexp_extract(RC_M1_SAA, '(\\d+)', 1), '') AS DOUBLE) AS saa,
    TRY_CAST(NULLIF(regexp_extract(RC_M1_UE_CUS_CN, '(\\d+)', 1), '') AS DOUBLE) AS cus,
    TRY_CAST(APV_CE_RAT AS DOUBLE) AS cxl, M12_SME_RY_ME_MCT_RAT AS indme, M12_SME_BZN_ME_MCT_RAT AS bznme FROM lb)
  WINDOW w AS (PARTITION BY ENCODED_MCT ORDER BY TA_YM))"""


def _f(cond: str) -> str:
    return f"CAST(COALESCE({cond}, false) AS INTEGER)"


@register("label_base", f"""WITH {panel_ctes()}, {_LB}
SELECT ENCODED_MCT, TA_YM, RC_M1_SAA, ROUND(MCT_UE_CLN_REU_RAT, 6) AS MCT_UE_CLN_REU_RAT FROM lb""")
def q_label_base(spark, sf):
    p = panel(spark, sf)
    b = label_base(p.usage, p.customers)
    return b.select(KEY_MCT, KEY_YM, "RC_M1_SAA", *r6("MCT_UE_CLN_REU_RAT"))


@register("closure_label", f"""WITH {panel_ctes()}, {_LB}, {_CL}
SELECT ENCODED_MCT, TA_YM, MCT_ME_D, y FROM cl""")
def q_closure_label(spark, sf):
    return _closure(spark, sf).select(KEY_MCT, KEY_YM, "MCT_ME_D", "y")


@register("proxy_label", f"""WITH {panel_ctes('number')}, {_LB}, {_PX},
s AS (SELECT *, {_f('dSAA <= -10')} + {_f('dCUS <= -10')} + {_f('cxl >= 90')} + {_f('indme >= 80')}
  + {_f('bznme >= 80')} AS sig FROM px)
SELECT ENCODED_MCT, TA_YM, dSAA, dCUS, sig, CAST(sig >= 2 AS INTEGER) AS y FROM s""")
def q_proxy_label(spark, sf):
    return proxy_label(_proxy_base(spark, sf)).select(KEY_MCT, KEY_YM, "dSAA", "dCUS", "sig", "y")


@register("proxy_label_any", f"""WITH {panel_ctes('number')}, {_LB}, {_PX}
SELECT ENCODED_MCT, TA_YM, {_f('dSAA <= -10 OR dCUS <= -10 OR cxl >= 90 OR indme >= 90 OR bznme >= 90')} AS y FROM px""")
def q_proxy_label_any(spark, sf):
    return proxy_label_any(_proxy_base(spark, sf)).select(KEY_MCT, KEY_YM, "y")


@register("topq_label", f"""WITH {scored_ctes(False)}, {_LB},
tq AS (SELECT lb.ENCODED_MCT, lb.TA_YM, COALESCE(a.p_final, 0.0) AS pf FROM alerted a
  RIGHT JOIN lb ON a.ENCODED_MCT = lb.ENCODED_MCT AND a.TA_YM = lb.TA_YM)
SELECT ENCODED_MCT, TA_YM, ROUND(pf, 6) AS pf, CAST(pf >= (SELECT quantile_cont(pf, 0.9) FROM tq) AS INTEGER) AS y
FROM tq""")
def q_topq_label(spark, sf):
    p = panel(spark, sf)
    keys = label_base(p.usage, p.customers)
    out = topq_label(keys, scored(spark, sf, with_preds=False), 0.10)
    return out.select(KEY_MCT, KEY_YM, *r6("pf"), "y")


@register("nlargest_label", f"""WITH {scored_ctes(False)}
SELECT ENCODED_MCT, TA_YM, ROUND(p_final, 6) AS p_final, CAST(row_number() OVER (ORDER BY p_final DESC, ENCODED_MCT,
  TA_YM) <= 50 AS INTEGER) AS y FROM alerted""")
def q_nlargest_label(spark, sf):
    return nlargest_label(scored(spark, sf, with_preds=False), 50).select(KEY_MCT, KEY_YM, *r6("p_final"), "y")


def _f2(cond: str) -> str:
    return f"CAST(COALESCE({cond}, false) AS INTEGER)"


_CASCADE_SQL = f"""WITH {scored_ctes(False)}, {_LB}, {_CL},
pxs AS (SELECT lb.ENCODED_MCT, lb.TA_YM,
  TRY_CAST(NULLIF(regexp_extract(lb.RC_M1_SAA, '(\\d+)', 1), '') AS DOUBLE) AS saa,
  TRY_CAST(NULLIF(regexp_extract(lb.RC_M1_UE_CUS_CN, '(\\d+)', 1), '') AS DOUBLE) AS cus,
  sm.r_share AS cxl, lb.M12_SME_RY_ME_MCT_RAT AS indme, lb.M12_SME_BZN_ME_MCT_RAT AS bznme
  FROM lb LEFT JOIN sm ON CAST(sm.suppkey AS VARCHAR) = lb.ENCODED_MCT AND sm.month = lb.TA_YM),
px AS (SELECT *, saa - LAG(saa) OVER w AS dSAA, cus - LAG(cus) OVER w AS dCUS FROM pxs
  WINDOW w AS (PARTITION BY ENCODED_MCT ORDER BY TA_YM)),
pxy AS (SELECT ENCODED_MCT, TA_YM, CAST({_f2('dSAA <= -10')} + {_f2('dCUS <= -10')} + {_f2('cxl >= 90')}
  + {_f2('indme >= 80')} + {_f2('bznme >= 80')} >= 2 AS INTEGER) AS y FROM px),
tq AS (SELECT lb.ENCODED_MCT, lb.TA_YM, COALESCE(a.p_final, 0.0) AS pf FROM alerted a
  RIGHT JOIN lb ON a.ENCODED_MCT = lb.ENCODED_MCT AND a.TA_YM = lb.TA_YM),
tqy AS (SELECT ENCODED_MCT, TA_YM, CAST(pf >= (SELECT quantile_cont(pf, 0.9) FROM tq) AS INTEGER) AS y FROM tq),
nl AS (SELECT ENCODED_MCT, TA_YM, CAST(row_number() OVER (ORDER BY p_final DESC, ENCODED_MCT, TA_YM) <= 50 AS INTEGER)
  AS y FROM alerted),
choice AS (SELECT CASE WHEN (SELECT COUNT(DISTINCT y) FROM cl) >= 2 THEN 'closure'
  WHEN (SELECT COUNT(DISTINCT y) FROM pxy) >= 2 AND (SELECT SUM(y) FROM pxy) > 0 THEN 'proxy'
  WHEN (SELECT COUNT(DISTINCT y) FROM tqy) >= 2 THEN 'topq' ELSE 'nlargest' END AS src)
SELECT cl.ENCODED_MCT, cl.TA_YM, CAST(CASE src WHEN 'closure' THEN cl.y WHEN 'proxy' THEN pxy.y WHEN 'topq' THEN tqy.y
  ELSE nl.y END AS INTEGER) AS y, src AS source
FROM cl CROSS JOIN choice
LEFT JOIN pxy ON cl.ENCODED_MCT = pxy.ENCODED_MCT AND cl.TA_YM = pxy.TA_YM
LEFT JOIN tqy ON cl.ENCODED_MCT = tqy.ENCODED_MCT AND cl.TA_YM = tqy.TA_YM
LEFT JOIN nl ON cl.ENCODED_MCT = nl.ENCODED_MCT AND cl.TA_YM = nl.TA_YM"""


@register("label_cascade", _CASCADE_SQL)
def q_label_cascade(spark, sf):
    p = panel(spark, sf)
    return label_cascade(label_base(p.usage, p.customers), _proxy_base(spark, sf), p.merchants,
                         scored(spark, sf, with_preds=False))


_CTES = _CASCADE_SQL[:_CASCADE_SQL.index("choice AS (")].rstrip().rstrip(",")


@register("label_cascade_branches", f"""{_CTES}
SELECT 'no close dates' AS given, 'proxy' AS source, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS positives, COUNT(DISTINCT ENCODED_MCT || TA_YM) AS n_keys FROM pxy
UNION ALL SELECT 'no signals either', 'topq', COUNT(*), CAST(SUM(y) AS BIGINT), COUNT(DISTINCT ENCODED_MCT || TA_YM) FROM tqy
UNION ALL SELECT 'equal scores', 'nlargest', COUNT(*), CAST(SUM(y) AS BIGINT), COUNT(DISTINCT ENCODED_MCT || TA_YM) FROM nl""")
def q_label_cascade_branches(spark, sf):
    """The cascade when no store closes, when no signal is left either, and when all scores are equal besides."""
    p = panel(spark, sf)
    base, number, scores = label_base(p.usage, p.customers), _proxy_base(spark, sf), scored(spark, sf, with_preds=False)
    open_ = p.merchants.withColumn(CLOSE_DATE, F.lit(None).cast("date"))
    quiet = number.withColumns({c: F.lit(0.0) for c in ("APV_CE_RAT", "M12_SME_RY_ME_MCT_RAT", "M12_SME_BZN_ME_MCT_RAT")}
                               | {c: F.lit("25-50%") for c in ("RC_M1_SAA", "RC_M1_UE_CUS_CN")})
    cases = {"no close dates": (number, scores), "no signals either": (quiet, scores), "equal scores": (quiet, scores.withColumn("p_final", F.lit(0.5)))}
    parts = [label_cascade(base, num, open_, sc).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"), F.countDistinct(KEY_MCT, KEY_YM).alias("n_keys"))
        .select(F.lit(given).alias("given"), "source", "n", "positives", "n_keys") for given, (num, sc) in cases.items()]
    return reduce(DataFrame.unionByName, parts)


@register("label_distribution", f"""WITH {panel_ctes()}, {_LB}, {_CL}
SELECT y, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM cl), 6) AS share,
  (SELECT COUNT(DISTINCT y) FROM cl) AS n_classes FROM cl GROUP BY y""")
def q_label_distribution(spark, sf):
    lab = _closure(spark, sf)
    k = lab.select(F.countDistinct("y")).scalar()
    return class_summary(lab).select("y", "n", F.round("share", 6).alias("share"), k.alias("n_classes"))


@register("class_weights", f"""WITH {panel_ctes()}, {_LB}, {_CL}
SELECT y, COUNT(*) AS n, ROUND((SELECT COUNT(*) FROM cl) / (2.0 * COUNT(*)), 6) AS weight FROM cl GROUP BY y""")
def q_class_weights(spark, sf):
    return class_summary(_closure(spark, sf)).select("y", "n", F.round("weight", 6).alias("weight"))


_SPLIT = f"""{_LB}, {_CL},
h AS (SELECT ENCODED_MCT, TA_YM, y, md5(ENCODED_MCT || '|' || strftime(TA_YM, '%Y-%m-%d') || '|42') AS hh,
  COUNT(*) OVER (PARTITION BY y) AS n_c FROM cl),
sp AS (SELECT ENCODED_MCT, TA_YM, y, CAST(row_number() OVER (PARTITION BY y ORDER BY hh)
  <= GREATEST(1, round_even(0.25 * n_c, 0)) AS INTEGER) AS is_test FROM h)"""


@register("stratified_split", f"""WITH {panel_ctes()}, {_SPLIT}
SELECT ENCODED_MCT, TA_YM, y, is_test, 1 - is_test AS is_train FROM sp""")
def q_stratified_split(spark, sf):
    return stratified_split(_closure(spark, sf).select(KEY_MCT, KEY_YM, "y")).select(
        KEY_MCT, KEY_YM, "y", "is_test", "is_train")


@register("median_impute", f"""WITH {panel_ctes()}, {_SPLIT},
t AS (SELECT cl.* FROM cl JOIN sp ON cl.ENCODED_MCT = sp.ENCODED_MCT AND cl.TA_YM = sp.TA_YM WHERE sp.is_test = 0)
{' UNION ALL '.join(f"SELECT '{c}' AS feature, ROUND(quantile_cont({c}, 0.5), 6) AS median FROM t" for c in NUM_FEATURES)}""")
def q_median_impute(spark, sf):
    """Medians fitted on the training split (applied with ``impute_medians``)."""
    lab = _closure(spark, sf)
    split = stratified_split(lab.select(KEY_MCT, KEY_YM, "y"))
    train = lab.join(split.where("is_train = 1").select(KEY_MCT, KEY_YM), [KEY_MCT, KEY_YM])
    return fit_medians(train, NUM_FEATURES).select("feature", F.round("median", 6).alias("median"))


_DOC = """d AS (SELECT l.quality, l.toxic, ROUND(ln(1 + doc.n_chars), 1) AS score FROM labels l
  JOIN documents doc ON l.doc_id = doc.doc_id)"""


def _doc_scores(spark, sf):
    t = Tables(spark, sf)
    return (t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
            .select("quality", "toxic", F.round(F.log(F.lit(1.0) + F.col("n_chars")), 1).alias("score")))


def _metric_targets(spark, sf):
    """(target, score, y) rows of all three evaluations, so one grouped ranking pass serves them all."""
    d = _doc_scores(spark, sf)
    r = _closure(spark, sf).join(scored(spark, sf).select(KEY_MCT, KEY_YM, F.col("p_final").alias("score")),
                                 [KEY_MCT, KEY_YM])
    return (d.select(F.lit("quality").alias("target"), "score", F.col("quality").alias("y"))
            .unionByName(d.select(F.lit("toxic").alias("target"), "score", F.col("toxic").alias("y")))
            .unionByName(r.select(F.lit("closure").alias("target"), "score", "y")))


def _auc_sql(src: str, label: str, target: str) -> str:
    return f"""SELECT '{target}' AS target, ROUND(SUM(pos * (cum_neg - 0.5 * neg)) / (SUM(pos) * SUM(neg)), 6) AS roc_auc,
  CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg FROM (
  SELECT *, SUM(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg FROM (
    SELECT score, SUM({label}) AS pos, SUM(1 - {label}) AS neg FROM {src} WHERE score IS NOT NULL GROUP BY score))"""


def _ap_sql(src: str, label: str, target: str) -> str:
    return f"""SELECT '{target}' AS target, ROUND(SUM(pos * cum_pos / cum_n) / SUM(pos), 6) AS avg_precision,
  CAST(SUM(pos) AS BIGINT) AS n_pos FROM (
  SELECT *, SUM(pos) OVER w AS cum_pos, SUM(n) OVER w AS cum_n FROM (
    SELECT score, SUM({label}) AS pos, COUNT(*) AS n FROM {src} WHERE score IS NOT NULL GROUP BY score)
  WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


_RISK_Y = f"""{_LB}, {_CL}, r AS (SELECT cl.y, a.p_final AS score FROM cl JOIN alerted a
  ON cl.ENCODED_MCT = a.ENCODED_MCT AND cl.TA_YM = a.TA_YM)"""


@register("roc_auc", f"""WITH {scored_ctes(True)}, {_DOC}, {_RISK_Y}
{_auc_sql('d', 'quality', 'quality')} UNION ALL {_auc_sql('d', 'toxic', 'toxic')} UNION ALL {_auc_sql('r', 'y', 'closure')}""")
def q_roc_auc(spark, sf):
    out = roc_auc(_metric_targets(spark, sf), "score", "y", group_cols=["target"])
    return out.select("target", F.round("roc_auc", 6).alias("roc_auc"), "n_pos", "n_neg")


@register("avg_precision", f"""WITH {scored_ctes(True)}, {_DOC}, {_RISK_Y}
{_ap_sql('d', 'quality', 'quality')} UNION ALL {_ap_sql('d', 'toxic', 'toxic')} UNION ALL {_ap_sql('r', 'y', 'closure')}""")
def q_avg_precision(spark, sf):
    out = average_precision(_metric_targets(spark, sf), "score", "y", group_cols=["target"])
    return out.select("target", F.round("avg_precision", 6).alias("avg_precision"), "n_pos")


@register("safe_metrics", f"""WITH {scored_ctes(True)}, {_DOC}, {_RISK_Y},
c AS (SELECT 'quality' AS target, quality AS y FROM d UNION ALL SELECT 'toxic', toxic FROM d UNION ALL SELECT 'closure', y FROM r)
SELECT target, y AS only_class, CAST(NULL AS DOUBLE) AS roc_auc, CAST(NULL AS DOUBLE) AS avg_precision, 'single-class' AS note,
  CAST(SUM(y) AS BIGINT) AS n_pos, COUNT(*) - CAST(SUM(y) AS BIGINT) AS n_neg FROM c GROUP BY target, y""")
def q_safe_metrics(spark, sf):
    """Both ranking metrics within each class of each target: no number, and why, and the counts."""
    d = _metric_targets(spark, sf).withColumn("only_class", F.col("y").cast("int"))
    auc = roc_auc(d, "score", "y", group_cols=["target", "only_class"])
    ap = average_precision(d, "score", "y", group_cols=["target", "only_class"]).select("target", "only_class", "avg_precision")
    return auc.join(ap, ["target", "only_class"]).select("target", "only_class", "roc_auc", "avg_precision", "note", "n_pos", "n_neg")


@register("platt_lstsq", f"""WITH {panel_ctes()}, {_LB}, {_CL},
pm AS (SELECT p.ENCODED_MCT, p.TA_YM, LEAST(GREATEST(0.25 * pred_xgb + 0.25 * pred_lgbm + 0.25 * pred_rf + 0.15 * pred_gb
  + 0.10 * pred_dl, 0.0), 1.0) AS p_model, cl.y FROM preds p JOIN cl ON p.ENCODED_MCT = cl.ENCODED_MCT AND p.TA_YM = cl.TA_YM),
x AS (SELECT *, ln(LEAST(GREATEST(p_model, 1e-6), 1 - 1e-6) / (1 - LEAST(GREATEST(p_model, 1e-6), 1 - 1e-6))) AS lx FROM pm),
ab AS (SELECT regr_slope(y, lx) AS a, regr_intercept(y, lx) AS b FROM x)
SELECT ENCODED_MCT, TA_YM, ROUND(p_model, 6) AS p_model,
  ROUND(LEAST(GREATEST(1.0 / (1.0 + exp(-(a * lx + b))), 0.0), 1.0), 6) AS p_cal FROM x, ab""")
def q_platt_lstsq(spark, sf):
    """Least-squares Platt fit of the closure label on the ensemble score, applied to every scored row."""
    p = panel(spark, sf)
    pm = p.preds.withColumn("p_model", weighted_ensemble(p.preds))
    lab = _closure(spark, sf).select(KEY_MCT, KEY_YM, "y")
    d = pm.join(lab, [KEY_MCT, KEY_YM])
    return calibrate_lstsq(d, "p_model", "y").select(KEY_MCT, KEY_YM, *r6("p_model", "p_cal"))
