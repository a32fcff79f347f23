"""DuckDB SQL for the scoring path (oracle only): join, bin ranks, windows, risks, blend, alerts."""
from __future__ import annotations

from storewatch.constants import AGE_COLS, BIN2RANK, BIN_COLS, TYPE_COLS
from storewatch.plans.oracle_panel import panel_ctes


def clip01(e: str) -> str:
    return f"(CASE WHEN ({e}) IS NULL THEN NULL WHEN ({e}) < 0 THEN 0.0::DOUBLE WHEN ({e}) > 1 THEN 1.0::DOUBLE ELSE ({e}) END)"


def zero01(e: str) -> str:
    return f"COALESCE({clip01(e)}, 0.0::DOUBLE)"


def relu_minus(e: str) -> str:
    return f"(CASE WHEN ({e}) IS NULL THEN NULL ELSE GREATEST(-({e}), 0.0::DOUBLE) + 0.0 END)"


def to_pct(e: str) -> str:
    return clip01(f"({e}) / 100.0")


def logistic(e: str) -> str:
    return f"(1.0 / (1.0 + exp(LEAST(-({e}), 700.0))))"


def nanmax(a: str, b: str) -> str:
    return f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL ELSE GREATEST({a}, {b}) END)"


def bin_rank(col: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in BIN2RANK.items())
    t = f"trim(CAST({col} AS VARCHAR))"
    num = f"TRY_CAST({t} AS DOUBLE)"
    return f"COALESCE(CASE {t} {cases} END, CASE WHEN isnan({num}) THEN NULL ELSE {num} END)"


def joined_ctes(cancel_form: str = "bin") -> str:
    """Panel + ``j``: usage LEFT JOIN customers LEFT JOIN merchants with ranks."""
    ranks = ",\n    ".join(f"COALESCE({bin_rank('u.' + c)}, 0.5) AS {c}_RANK" for c in BIN_COLS)
    return panel_ctes(cancel_form) + f""",
j AS (
  SELECT u.*, c.* EXCLUDE (ENCODED_MCT, TA_YM), m.* EXCLUDE (ENCODED_MCT),
    CAST(strptime(u.TA_YM, '%Y%m') AS DATE) AS MONTH_DATE,
    {ranks}
  FROM ds2 u LEFT JOIN ds3 c ON u.ENCODED_MCT = c.ENCODED_MCT AND u.TA_YM = c.TA_YM
  LEFT JOIN ds1 m ON u.ENCODED_MCT = m.ENCODED_MCT
)"""


def _sq(cols) -> str:
    parts = [f"POW({zero01(f'COALESCE({c}, 0) / 100.0')}, 2)" for c in cols]
    return " + ".join(parts)


def _order(boundary: str) -> str:
    return "PARTITION BY ENCODED_MCT ORDER BY TA_YM" if boundary == "store" else "ORDER BY ENCODED_MCT, TA_YM"


def _z_ctes(src: str, specs: dict, out: str, boundary: str = "store") -> str:
    """Three CTEs: x + rolling median, deviation + rolling MAD, z."""
    w = f"({_order(boundary)} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
    meds = ",\n    ".join(
        f"CASE WHEN COUNT({n}_x) OVER {w} >= 6 THEN MEDIAN({n}_x) OVER {w} END AS {n}_med" for n in specs)
    xs = ",\n    ".join(f"{e} AS {n}_x" for n, e in specs.items())
    mads = ",\n    ".join(
        f"1.4826 * CASE WHEN COUNT(ABS({n}_x - {n}_med)) OVER {w} >= 6 THEN MEDIAN(ABS({n}_x - {n}_med)) OVER {w} END"
        f" AS {n}_mad" for n in specs)
    zs = ",\n    ".join(f"({n}_x - {n}_med) / ({n}_mad + 0.000001) AS {n}_z" for n in specs)
    return f"""{out}_x AS (SELECT *, {xs} FROM {src}),
{out}_m AS (SELECT *, {meds} FROM {out}_x),
{out}_d AS (SELECT *, {mads} FROM {out}_m),
{out} AS (SELECT *, {zs} FROM {out}_d)"""


def risk_ctes(cancel_form: str = "bin", boundary: str = "store") -> str:
    """... + ``risks``: ENCODED_MCT, TA_YM (date), Sales_Risk, Customer_Risk, Market_Risk, RiskScore."""
    ws = f"({_order(boundary)})"
    base = f"""base AS (
  SELECT ENCODED_MCT, MONTH_DATE AS TA_YM,
    RC_M1_SAA_RANK AS rS, RC_M1_TO_UE_CT_RANK AS rC, RC_M1_AV_NP_AT_RANK AS rA, APV_CE_RAT_RANK AS rX,
    RC_M1_UE_CUS_CN_RANK AS rU, MCT_OPE_MS_CN_RANK AS age,
    {zero01(to_pct('DLV_SAA_RAT'))} AS dlv,
    {zero01(to_pct('MCT_UE_CLN_REU_RAT'))} AS q_reu,
    {zero01(to_pct('MCT_UE_CLN_NEW_RAT'))} AS q_new,
    {_sq(AGE_COLS)} AS h_age,
    {_sq(TYPE_COLS)} AS h_type,
    M12_SME_RY_SAA_PCE_RT, M12_SME_BZN_SAA_PCE_RT, M12_SME_RY_ME_MCT_RAT, M12_SME_BZN_ME_MCT_RAT,
    M1_SME_RY_SAA_RAT, M1_SME_RY_CNT_RAT
  FROM j
),
base2 AS (
  SELECT *, rS - LAG(rS) OVER {ws} AS mom_rS, rC - LAG(rC) OVER {ws} AS mom_rC, rU - LAG(rU) OVER {ws} AS mom_rU,
    dlv - LAG(dlv) OVER {ws} AS mom_dlv, q_reu - LAG(q_reu) OVER {ws} AS mom_reu, q_new - LAG(q_new) OVER {ws} AS mom_new
  FROM base
)"""
    zs = _z_ctes("base2", {"zA": "rA", "zX": "rX", "zD": "dlv", "zU": "rU", "zH": "h_age", "zT": "h_type"}, "zz",
                 boundary)
    terms = f"""terms AS (
  SELECT ENCODED_MCT, TA_YM, dlv,
    {zero01(f"({relu_minus('mom_rS')} + {relu_minus('mom_rC')}) / 2.0")} AS s_drop,
    {zero01(relu_minus('zA_z'))} AS s_aov,
    {zero01(nanmax('rX', logistic('zX_z')))} AS s_cxl,
    {zero01(f"1.0 - {to_pct('M12_SME_RY_SAA_PCE_RT')}")} AS ind_rank,
    {zero01(f"1.0 - {to_pct('M12_SME_BZN_SAA_PCE_RT')}")} AS bzn_rank,
    {zero01(f"{relu_minus('-mom_dlv')} + {relu_minus('-zD_z')}")} AS jump,
    {zero01(f"{relu_minus('mom_rU')} + {relu_minus('zU_z')}")} AS c_drop,
    {zero01(relu_minus('mom_reu'))} AS c_loyal,
    {zero01(relu_minus('mom_new'))} AS c_acq,
    {zero01(nanmax('0.0', 'zH_z'))} AS c_mix,
    {zero01(nanmax('0.0', 'zT_z'))} AS c_type,
    {zero01(f"({zero01(to_pct('M12_SME_RY_ME_MCT_RAT'))} + {zero01(to_pct('M12_SME_BZN_ME_MCT_RAT'))}) / 2.0")} AS m_closure,
    {zero01(f"({zero01('1.0 - ' + to_pct('M1_SME_RY_SAA_RAT'))} + {zero01('1.0 - ' + to_pct('M1_SME_RY_CNT_RAT'))}) / 2.0")} AS m_under,
    {zero01('4.0 * LEAST(age, 1.0 - age)')} AS m_age
  FROM zz
),
risks0 AS (
  SELECT ENCODED_MCT, TA_YM,
    {zero01(f"0.35 * s_drop + 0.15 * s_aov + 0.20 * s_cxl + 0.20 * {zero01('(ind_rank + bzn_rank) / 2.0')} + 0.10 * (dlv * jump)")} AS Sales_Risk,
    {zero01("0.40 * c_drop + 0.25 * c_loyal + 0.20 * c_acq + 0.10 * c_mix + 0.05 * c_type")} AS Customer_Risk,
    {zero01("0.50 * m_closure + 0.35 * m_under + 0.15 * m_age")} AS Market_Risk
  FROM terms
),
risks AS (
  SELECT *, 0.4 * COALESCE(Sales_Risk, 0) + 0.3 * COALESCE(Customer_Risk, 0) + 0.3 * COALESCE(Market_Risk, 0) AS RiskScore
  FROM risks0
)"""
    return joined_ctes(cancel_form) + ",\n" + base + ",\n" + zs + ",\n" + terms


def scored_ctes(with_preds: bool = False) -> str:
    """... + ``scored`` (p_model, p_final) + ``alerted`` (Alert by month quantiles)."""
    if with_preds:
        pm = ("CASE WHEN p.ENCODED_MCT IS NULL THEN NULL ELSE "
              + clip01("0.25 * p.pred_xgb + 0.25 * p.pred_lgbm + 0.25 * p.pred_rf + 0.15 * p.pred_gb + 0.10 * p.pred_dl")
              + " END")
        src = f"""scored0 AS (
  SELECT r.*, {pm} AS p_model FROM risks r LEFT JOIN preds p ON r.ENCODED_MCT = p.ENCODED_MCT AND r.TA_YM = p.TA_YM
)"""
    else:
        src = "scored0 AS (SELECT r.*, 0.0::DOUBLE AS p_model FROM risks r)"
    return risk_ctes() + f""",
{src},
scored AS (SELECT *, 0.6 * COALESCE(p_model, 0) + 0.4 * COALESCE(RiskScore, 0) AS p_final FROM scored0),
qs AS (
  SELECT TA_YM, quantile_cont(p_final, 0.8) AS qy, quantile_cont(p_final, 0.9) AS qo,
    quantile_cont(p_final, 0.97) AS qr
  FROM scored GROUP BY TA_YM
),
alerted AS (
  SELECT s.*, CASE WHEN s.TA_YM IS NULL THEN NULL WHEN p_final >= qr THEN 'RED' WHEN p_final >= qo THEN 'ORANGE'
    WHEN p_final >= qy THEN 'YELLOW' ELSE 'GREEN' END AS Alert
  FROM scored s LEFT JOIN qs ON s.TA_YM = qs.TA_YM
)"""


R6 = ["Sales_Risk", "Customer_Risk", "Market_Risk", "RiskScore", "p_model", "p_final"]


def round_cols(cols, prefix: str = "") -> str:
    return ", ".join(f"ROUND({prefix}{c}, 6) AS {c}" for c in cols)


def r6s(e: str) -> str:
    """Half-up rounding of the shortest decimal form of a double (how Spark's ``round`` behaves)."""
    return f"CAST(ROUND(CAST(CAST(({e}) AS VARCHAR) AS DECIMAL(38, 18)), 6) AS DOUBLE)"
