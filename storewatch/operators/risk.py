"""Rule risks: sales, customer and market components and the weighted RiskScore.

All three are computed on one frame in one window pass (the original computes each on its own sorted
copy and merges them back on the keys; here there is nothing to merge).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.constants import AGE_COLS, ALPHA, BETA, BIN_COLS, GAMMA, KEY_MCT, KEY_YM, TYPE_COLS
from storewatch.functions import sqlx as S
from storewatch.operators.windows import mom, store_window, with_global_chunks, with_robust_z_scores

RISK_COLS = ["Sales_Risk", "Customer_Risk", "Market_Risk", "RiskScore"]
INPUT_COLS = ["DLV_SAA_RAT", "MCT_UE_CLN_REU_RAT", "MCT_UE_CLN_NEW_RAT", *AGE_COLS, *TYPE_COLS,
              "M12_SME_RY_SAA_PCE_RT", "M12_SME_BZN_SAA_PCE_RT", "M12_SME_RY_ME_MCT_RAT", "M12_SME_BZN_ME_MCT_RAT",
              "M1_SME_RY_SAA_RAT", "M1_SME_RY_CNT_RAT"]


def _share_sq(df: DataFrame, cols: list) -> str:
    """Sum of squared shares (percent -> [0,1], missing/absent -> 0), no renormalisation."""
    terms = []
    for c in cols:
        w = S.zero01(f"{S.col_or_default(df, c, 0.0)} / 100.0D")
        terms.append(f"({w}) * ({w})")
    return " + ".join(terms)


def risk_inputs(df: DataFrame, store: str = KEY_MCT, month: str = KEY_YM, boundary: str = "store") -> DataFrame:
    """Window inputs: ranks, shares, month-over-month changes and robust z scores (intermediate columns
    are prefixed ``_``).

    ``boundary="store"`` (default): every window stays inside one store's history.
    ``boundary="global"``: windows run over the whole table sorted by (store, month), so a store's first
    months see the previous store's last months, as the original computation does; built with
    :func:`with_global_chunks` (halo rows are dropped by :func:`compute_all_risks`)."""
    if boundary == "global":
        df, w = with_global_chunks(df, [store, month])
        part, order = "_chunk", [store, month]
    elif boundary == "store":
        w = store_window(store, month)
        part, order = store, [month]
    else:
        raise ValueError(f"boundary must be 'store' or 'global', not {boundary!r}")
    pct0 = lambda c: S.x(S.zero01(S.to_percent(S.col_or_default(df, c, 0.0))))
    d = df.withColumns({
        "_rS": F.col("RC_M1_SAA_RANK"), "_rC": F.col("RC_M1_TO_UE_CT_RANK"), "_rA": F.col("RC_M1_AV_NP_AT_RANK"),
        "_rX": F.col("APV_CE_RAT_RANK"), "_rU": F.col("RC_M1_UE_CUS_CN_RANK"), "_age": F.col("MCT_OPE_MS_CN_RANK"),
        "_dlv": pct0("DLV_SAA_RAT"), "_q_reu": pct0("MCT_UE_CLN_REU_RAT"), "_q_new": pct0("MCT_UE_CLN_NEW_RAT"),
        "_h_age": S.x(_share_sq(df, AGE_COLS)),
        "_h_type": S.x(_share_sq(df, TYPE_COLS)),
    })
    d = d.withColumns({
        "_mom_rS": mom("_rS", w), "_mom_rC": mom("_rC", w), "_mom_rU": mom("_rU", w), "_mom_dlv": mom("_dlv", w),
        "_mom_reu": mom("_q_reu", w), "_mom_new": mom("_q_new", w),
    })
    return with_robust_z_scores(d, {"_zA": F.col("_rA"), "_zX": F.col("_rX"), "_zD": F.col("_dlv"), "_zU": F.col("_rU"),
                             "_zH": F.col("_h_age"), "_zT": F.col("_h_type")}, part, order)


def _stage(d: DataFrame, cols: dict) -> DataFrame:
    """Materialise terms (SQL text) as columns so later clips reference a column, not a copy of the subtree."""
    return d.withColumns({k: S.x(v) for k, v in cols.items()})


def with_sales_risk(d: DataFrame, df: DataFrame) -> DataFrame:
    d = _stage(d, {
        "_s_drop": S.zero01(f"({S.relu_minus('_mom_rS')} + {S.relu_minus('_mom_rC')}) / 2.0D"),
        "_s_aov": S.zero01(S.relu_minus("_zA_z")),
        "_s_cxl": S.zero01(S.nanmax("_rX", S.logistic("_zX_z"))),
        "_ind_pct": S.to_percent(S.col_or_default(df, "M12_SME_RY_SAA_PCE_RT", 50.0)),
        "_bzn_pct": S.to_percent(S.col_or_default(df, "M12_SME_BZN_SAA_PCE_RT", 50.0)),
        "_jump": S.zero01(f"{S.relu_minus('-_mom_dlv')} + {S.relu_minus('-_zD_z')}"),
    })
    d = _stage(d, {"_ind": S.zero01("1.0D - _ind_pct"), "_bzn": S.zero01("1.0D - _bzn_pct")})
    d = _stage(d, {"_s_peer": S.zero01("(_ind + _bzn) / 2.0D")})
    return _stage(d, {"Sales_Risk": S.zero01(
        "0.35D * _s_drop + 0.15D * _s_aov + 0.20D * _s_cxl + 0.20D * _s_peer + 0.10D * (_dlv * _jump)")})


def with_customer_risk(d: DataFrame) -> DataFrame:
    d = _stage(d, {
        "_c_drop": S.zero01(f"{S.relu_minus('_mom_rU')} + {S.relu_minus('_zU_z')}"),
        "_c_loyal": S.zero01(S.relu_minus("_mom_reu")),
        "_c_acq": S.zero01(S.relu_minus("_mom_new")),
        "_c_mix": S.zero01(S.nanmax("0.0D", "_zH_z")),
        "_c_type": S.zero01(S.nanmax("0.0D", "_zT_z")),
    })
    return _stage(d, {"Customer_Risk": S.zero01(
        "0.40D * _c_drop + 0.25D * _c_loyal + 0.20D * _c_acq + 0.10D * _c_mix + 0.05D * _c_type")})


def with_market_risk(d: DataFrame, df: DataFrame) -> DataFrame:
    d = _stage(d, {
        "_m_ind": S.to_percent(S.col_or_default(df, "M12_SME_RY_ME_MCT_RAT", 0.0)),
        "_m_bzn": S.to_percent(S.col_or_default(df, "M12_SME_BZN_ME_MCT_RAT", 0.0)),
        "_m_rev": S.to_percent(S.col_or_default(df, "M1_SME_RY_SAA_RAT", 100.0)),
        "_m_cnt": S.to_percent(S.col_or_default(df, "M1_SME_RY_CNT_RAT", 100.0)),
        "_m_a": "MCT_OPE_MS_CN_RANK",
    })
    d = _stage(d, {
        "_m_ind0": S.zero01("_m_ind"), "_m_bzn0": S.zero01("_m_bzn"),
        "_m_rev0": S.zero01("1.0D - _m_rev"), "_m_cnt0": S.zero01("1.0D - _m_cnt"),
        "_m_age": S.zero01("4.0D * (CASE WHEN _m_a IS NULL THEN NULL ELSE least(_m_a, 1.0D - _m_a) END)"),
    })
    d = _stage(d, {"_m_closure": S.zero01("(_m_ind0 + _m_bzn0) / 2.0D"),
                   "_m_under": S.zero01("(_m_rev0 + _m_cnt0) / 2.0D")})
    return _stage(d, {"Market_Risk": S.zero01("0.50D * _m_closure + 0.35D * _m_under + 0.15D * _m_age")})


def risk_score_expr() -> F.Column:
    return (F.lit(ALPHA) * F.coalesce(F.col("Sales_Risk"), F.lit(0.0))
            + F.lit(BETA) * F.coalesce(F.col("Customer_Risk"), F.lit(0.0))
            + F.lit(GAMMA) * F.coalesce(F.col("Market_Risk"), F.lit(0.0)))


def compute_all_risks(df: DataFrame, store: str = KEY_MCT, month: str = KEY_YM, keep: tuple = (),
                      boundary: str = "store") -> DataFrame:
    """Keys + Sales_Risk, Customer_Risk, Market_Risk, RiskScore (+ ``keep`` pass-through columns)."""
    needed = [store, month, *keep, *[f"{c}_RANK" for c in BIN_COLS], *INPUT_COLS]
    df = df.select(*[c for c in dict.fromkeys(needed) if c in df.columns])   # windows copy rows: carry only inputs
    d = risk_inputs(df, store, month, boundary)
    d = with_market_risk(with_customer_risk(with_sales_risk(d, df)), df)
    d = d.withColumn("RiskScore", risk_score_expr())
    if boundary == "global":
        d = d.where(~F.col("_halo"))
    return d.select(store, month, *keep, *RISK_COLS)


def compute_market_risk(df: DataFrame, store: str = KEY_MCT, month: str = KEY_YM) -> DataFrame:
    """Market risk has no window term: a pure projection, no shuffle."""
    return with_market_risk(df, df).select(store, month, "Market_Risk")
