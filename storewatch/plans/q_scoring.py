"""Scoring-path queries: join, bins, windows, risks, blend, alerts."""
from __future__ import annotations

from pyspark.sql import functions as F

from storewatch.constants import KEY_MCT, KEY_YM
from storewatch.functions.core import to_percent, zero01
from storewatch.operators.alerts import assign_alert_by_quantile, assign_alert_persistent
from storewatch.operators.ensemble import weighted_ensemble
from storewatch.operators.prepare import load_and_join, normalize_bins
from storewatch.operators.risk import compute_all_risks, compute_market_risk
from storewatch.operators.windows import mom, rolling_mean, rolling_median, store_window, with_robust_z
from storewatch.plans.catalog import panel, r6, register
from storewatch.plans.oracle_panel import panel_ctes
from storewatch.plans.oracle_risk import R6, joined_ctes, risk_ctes, round_cols, scored_ctes
from storewatch.plans.pipeline import OUTPUT_COLS, run_pipeline, score_rows

DBL_OUT = ["Sales_Risk", "Customer_Risk", "Market_Risk", "RiskScore", "p_model", "p_final"]


def _joined(spark, sf):
    p = panel(spark, sf)
    return normalize_bins(load_and_join(p.merchants, p.usage, p.customers))


# --- H14: full pipeline --------------------------------------------------------------------------
@register("risk_pipeline", f"""
WITH {scored_ctes(False)}
SELECT ENCODED_MCT, TA_YM, {round_cols(R6)}, Alert FROM alerted""")
def q_risk_pipeline(spark, sf):
    p = panel(spark, sf)
    out = run_pipeline(p.merchants, p.usage, p.customers)
    return out.select(KEY_MCT, KEY_YM, *r6(*DBL_OUT), "Alert")


@register("risk_pipeline_model", f"""
WITH {scored_ctes(True)}
SELECT ENCODED_MCT, TA_YM, {round_cols(R6)}, Alert FROM alerted""")
def q_risk_pipeline_model(spark, sf):
    p = panel(spark, sf)
    out = run_pipeline(p.merchants, p.usage, p.customers, preds=p.preds)
    return out.select(KEY_MCT, KEY_YM, *r6(*DBL_OUT), "Alert")


# --- C1/C2 + B1/B4 + B7 --------------------------------------------------------------------------
@register("load_and_join", f"""
WITH {joined_ctes()}
SELECT ENCODED_MCT, MONTH_DATE AS TA_YM, RC_M1_SAA, MCT_UE_CLN_NEW_RAT, HPSN_MCT_ZCD_NM, HPSN_MCT_BZN_CD_NM,
  MCT_ME_D, ROUND(M1_SME_RY_SAA_RAT, 6) AS M1_SME_RY_SAA_RAT FROM j""")
def q_load_and_join(spark, sf):
    p = panel(spark, sf)
    j = load_and_join(p.merchants, p.usage, p.customers)
    return j.select(KEY_MCT, KEY_YM, "RC_M1_SAA", "MCT_UE_CLN_NEW_RAT", "HPSN_MCT_ZCD_NM", "HPSN_MCT_BZN_CD_NM",
                    "MCT_ME_D", F.round("M1_SME_RY_SAA_RAT", 6).alias("M1_SME_RY_SAA_RAT"))


@register("normalize_bins", f"""
WITH {joined_ctes()}
SELECT ENCODED_MCT, MONTH_DATE AS TA_YM, RC_M1_SAA_RANK, RC_M1_TO_UE_CT_RANK, RC_M1_UE_CUS_CN_RANK,
  RC_M1_AV_NP_AT_RANK, APV_CE_RAT_RANK, MCT_OPE_MS_CN_RANK FROM j""")
def q_normalize_bins(spark, sf):
    return _joined(spark, sf).select(KEY_MCT, KEY_YM, "RC_M1_SAA_RANK", "RC_M1_TO_UE_CT_RANK", "RC_M1_UE_CUS_CN_RANK",
                                     "RC_M1_AV_NP_AT_RANK", "APV_CE_RAT_RANK", "MCT_OPE_MS_CN_RANK")


# --- H1-H4 ---------------------------------------------------------------------------------------
@register("sales_risk", f"WITH {risk_ctes()} SELECT ENCODED_MCT, TA_YM, ROUND(Sales_Risk, 6) AS Sales_Risk FROM risks0")
def q_sales_risk(spark, sf):
    return compute_all_risks(_joined(spark, sf)).select(KEY_MCT, KEY_YM, *r6("Sales_Risk"))


@register("customer_risk",
          f"WITH {risk_ctes()} SELECT ENCODED_MCT, TA_YM, ROUND(Customer_Risk, 6) AS Customer_Risk FROM risks0")
def q_customer_risk(spark, sf):
    return compute_all_risks(_joined(spark, sf)).select(KEY_MCT, KEY_YM, *r6("Customer_Risk"))


@register("market_risk",
          f"WITH {risk_ctes()} SELECT ENCODED_MCT, TA_YM, ROUND(Market_Risk, 6) AS Market_Risk FROM risks0")
def q_market_risk(spark, sf):
    return compute_market_risk(_joined(spark, sf)).select(KEY_MCT, KEY_YM, *r6("Market_Risk"))


@register("all_risks", f"""
WITH {risk_ctes()}
SELECT ENCODED_MCT, TA_YM, {round_cols(['Sales_Risk', 'Customer_Risk', 'Market_Risk', 'RiskScore'])} FROM risks""")
def q_all_risks(spark, sf):
    return compute_all_risks(_joined(spark, sf)).select(
        KEY_MCT, KEY_YM, *r6("Sales_Risk", "Customer_Risk", "Market_Risk", "RiskScore"))


# --- E1-E4 on the delivery share ------------------------------------------------------------------
_DLV_SQL = f"""
WITH {joined_ctes()},
b AS (SELECT ENCODED_MCT, MONTH_DATE AS TA_YM, COALESCE(CASE WHEN DLV_SAA_RAT / 100.0 < 0 THEN 0.0
  WHEN DLV_SAA_RAT / 100.0 > 1 THEN 1.0 ELSE DLV_SAA_RAT / 100.0 END, 0.0) AS x FROM j),
m AS (SELECT *, CASE WHEN COUNT(x) OVER w >= 6 THEN MEDIAN(x) OVER w END AS med FROM b
  WINDOW w AS (PARTITION BY ENCODED_MCT ORDER BY TA_YM ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
d AS (SELECT *, 1.4826 * CASE WHEN COUNT(ABS(x - med)) OVER w >= 6 THEN MEDIAN(ABS(x - med)) OVER w END AS mad FROM m
  WINDOW w AS (PARTITION BY ENCODED_MCT ORDER BY TA_YM ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, (x - med) / (mad + 0.000001) AS z, x - LAG(x) OVER (PARTITION BY ENCODED_MCT ORDER BY TA_YM) AS mom
  FROM d)"""


def _dlv_frame(spark, sf):
    j = _joined(spark, sf)
    w = store_window()
    d = j.select(KEY_MCT, KEY_YM, zero01(to_percent("DLV_SAA_RAT")).alias("x"))
    d = with_robust_z(d, {"r": F.col("x")}, w)
    return d.withColumns({"med": F.col("r_med"), "mad": F.col("r_mad"), "z": F.col("r_z"), "mom": mom("x", w)})


@register("mom", _DLV_SQL + " SELECT ENCODED_MCT, TA_YM, ROUND(mom, 6) AS mom FROM z")
def q_mom(spark, sf):
    return _dlv_frame(spark, sf).select(KEY_MCT, KEY_YM, *r6("mom"))


@register("rolling_median", _DLV_SQL + " SELECT ENCODED_MCT, TA_YM, ROUND(med, 6) AS med FROM z")
def q_rolling_median(spark, sf):
    j = _joined(spark, sf)
    w = store_window()
    d = j.select(KEY_MCT, KEY_YM, zero01(to_percent("DLV_SAA_RAT")).alias("x"))
    return d.select(KEY_MCT, KEY_YM, F.round(rolling_median("x", w), 6).alias("med"))


@register("rolling_mad", _DLV_SQL + " SELECT ENCODED_MCT, TA_YM, ROUND(mad, 6) AS mad FROM z")
def q_rolling_mad(spark, sf):
    return _dlv_frame(spark, sf).select(KEY_MCT, KEY_YM, *r6("mad"))


@register("robust_z", _DLV_SQL + " SELECT ENCODED_MCT, TA_YM, ROUND(x, 6) AS x, ROUND(med, 6) AS med, "
                                 "ROUND(mad, 6) AS mad, ROUND(z, 6) AS z FROM z")
def q_robust_z(spark, sf):
    return _dlv_frame(spark, sf).select(KEY_MCT, KEY_YM, *r6("x", "med", "mad", "z"))


# --- H11 / H12 / H13 -----------------------------------------------------------------------------
@register("quantile_alert", f"""
WITH {scored_ctes(False)}
SELECT ENCODED_MCT, TA_YM, ROUND(p_final, 6) AS p_final, Alert FROM alerted""")
def q_quantile_alert(spark, sf):
    p = panel(spark, sf)
    out = run_pipeline(p.merchants, p.usage, p.customers)
    return out.select(KEY_MCT, KEY_YM, *r6("p_final"), "Alert")


@register("quantile_alert_fallback", f"""
WITH {scored_ctes(False)},
g AS (SELECT s.*, m.HPSN_MCT_ZCD_NM FROM scored s JOIN ds1 m ON s.ENCODED_MCT = m.ENCODED_MCT),
q AS (SELECT HPSN_MCT_ZCD_NM, TA_YM, quantile_cont(p_final, 0.8) AS qy, quantile_cont(p_final, 0.9) AS qo,
  quantile_cont(p_final, 0.97) AS qr FROM g GROUP BY HPSN_MCT_ZCD_NM, TA_YM)
SELECT g.ENCODED_MCT, g.TA_YM, g.HPSN_MCT_ZCD_NM, ROUND(p_final, 6) AS p_final,
  CASE WHEN p_final >= qr THEN 'RED' WHEN p_final >= qo THEN 'ORANGE' WHEN p_final >= qy THEN 'YELLOW' ELSE 'GREEN' END
  AS Alert
FROM g JOIN q ON g.HPSN_MCT_ZCD_NM = q.HPSN_MCT_ZCD_NM AND g.TA_YM = q.TA_YM""")
def q_quantile_alert_fallback(spark, sf):
    """Industry is carried into the score frame, so the fallback resolves to (industry, month)."""
    p = panel(spark, sf)
    scored = score_rows(p.merchants, p.usage, p.customers)
    scored = scored.join(p.merchants.select(KEY_MCT, "HPSN_MCT_ZCD_NM"), KEY_MCT)
    out = assign_alert_by_quantile(scored, group_cols=None, score_col="p_final")
    return out.select(KEY_MCT, KEY_YM, "HPSN_MCT_ZCD_NM", *r6("p_final"), "Alert")


@register("persistence_alert", f"""
WITH {scored_ctes(True)},
pb AS (SELECT *, AVG(p_final) OVER (PARTITION BY ENCODED_MCT ORDER BY TA_YM ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
  AS pbar FROM scored)
SELECT ENCODED_MCT, TA_YM, ROUND(p_final, 6) AS p_final, ROUND(pbar, 6) AS pbar,
  CASE WHEN p_final >= 0.4 AND pbar >= 0.35 THEN 'RED' WHEN p_final >= 0.3 THEN 'ORANGE'
  WHEN p_final >= 0.2 THEN 'YELLOW' ELSE 'GREEN' END AS Alert FROM pb""")
def q_persistence_alert(spark, sf):
    p = panel(spark, sf)
    scored = score_rows(p.merchants, p.usage, p.customers, preds=p.preds)
    out = assign_alert_persistent(scored).withColumn("pbar", rolling_mean("p_final", store_window(), 3))
    return out.select(KEY_MCT, KEY_YM, *r6("p_final", "pbar"), "Alert")


# --- H5 / H6 ------------------------------------------------------------------------------------
_ENS = "0.25 * pred_xgb + 0.25 * pred_lgbm + 0.25 * pred_rf + 0.15 * pred_gb + 0.10 * pred_dl"


@register("weighted_ensemble", f"""
WITH {panel_ctes()}
SELECT ENCODED_MCT, TA_YM, ROUND(LEAST(GREATEST({_ENS}, 0.0), 1.0), 6) AS p_model,
  ROUND(LEAST(GREATEST(0.25 * pred_xgb + 0.25 * pred_lgbm + 0.15 * pred_gb, 0.0), 1.0), 6) AS p_three FROM preds""")
def q_weighted_ensemble(spark, sf):
    """All five models, and the same table with two model columns absent (skipped, not renormalised)."""
    p = panel(spark, sf).preds
    three = p.drop("pred_rf", "pred_dl")
    return p.select(KEY_MCT, KEY_YM, F.round(weighted_ensemble(p), 6).alias("p_model"),
                    F.round(weighted_ensemble(three), 6).alias("p_three"))


@register("weighted_ensemble_renorm", f"""
WITH {panel_ctes()}
SELECT ENCODED_MCT, TA_YM, ROUND(LEAST(GREATEST({_ENS}, 0.0), 1.0), 6) AS p_model,
  ROUND(LEAST(GREATEST((0.25 * pred_xgb + 0.25 * pred_lgbm + 0.15 * pred_gb) / 0.65, 0.0), 1.0), 6) AS p_three
FROM preds""")
def q_weighted_ensemble_renorm(spark, sf):
    base = panel(spark, sf).preds.withColumnRenamed("pred_gb", "pred_gbdt")   # alias spelling
    three = base.drop("pred_rf", "pred_dl")
    return base.select(KEY_MCT, KEY_YM, F.round(weighted_ensemble(base, renormalize=True), 6).alias("p_model"),
                       F.round(weighted_ensemble(three, renormalize=True), 6).alias("p_three"))


@register("all_risks_global", f"""
WITH {risk_ctes(boundary='global')}
SELECT ENCODED_MCT, TA_YM, {round_cols(['Sales_Risk', 'Customer_Risk', 'Market_Risk', 'RiskScore'])} FROM risks""")
def q_all_risks_global(spark, sf):
    """Parity mode: windows over the whole (store, month)-sorted table, crossing store boundaries."""
    return compute_all_risks(_joined(spark, sf), boundary="global").select(
        KEY_MCT, KEY_YM, *r6("Sales_Risk", "Customer_Risk", "Market_Risk", "RiskScore"))
