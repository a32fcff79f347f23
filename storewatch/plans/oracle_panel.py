"""DuckDB SQL that derives the same merchant/usage/customer/prediction tables as
:func:`storewatch.sources.panel.build_panel`, written independently with plain window functions.
Used only as the correctness oracle."""
from __future__ import annotations

from storewatch.sources.panel import BIN_EDGES, BIN_TOP, PRED_PRIMES, SEGMENT_BANDS


def _bin(expr: str) -> str:
    cases = " ".join(f"WHEN {expr} <= {edge} THEN '{label}'" for edge, label in BIN_EDGES)
    return f"CASE WHEN {expr} IS NULL THEN NULL {cases} ELSE '{BIN_TOP}' END"


def _seg_cols() -> str:
    out = []
    for sex, tag in ((0, "MAL"), (1, "FME")):
        for seg, band in SEGMENT_BANDS:
            out.append(f"SUM(CASE WHEN sex = {sex} AND seg = '{seg}' THEN lines_n ELSE 0 END) AS _{tag}_{band}")
    return ",\n    ".join(out)


def _share(num: str) -> str:
    return f"ROUND(100.0::DOUBLE * {num} / lines, 6)"


def panel_ctes(cancel_form: str = "bin") -> str:
    """``WITH`` body (no leading WITH) defining ds1, ds2, ds3, preds."""
    age = ",\n    ".join(
        _share(f"_{tag}_{band}") + f" AS M12_{tag}_{band}_RAT" for tag in ("MAL", "FME") for _, band in SEGMENT_BANDS)
    preds = ",\n    ".join(
        f"((suppkey * 7919 + mi) * {p} % 1000) / 1000.0::DOUBLE AS {name}" for name, p in PRED_PRIMES.items())
    cancel = _bin("pr_r") if cancel_form == "bin" else "r_share"
    return f"""
lines AS (
  SELECT l.l_suppkey AS suppkey, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS month,
         o.o_custkey AS cust, l.l_orderkey AS ok,
         CAST(ROUND(l.l_extendedprice * 100) AS BIGINT) * (100 - CAST(ROUND(l.l_discount * 100) AS BIGINT)) AS rev4,
         CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS is_r,
         CASE WHEN l.l_linestatus = 'F' THEN 1 ELSE 0 END AS is_f,
         o.o_custkey % 2 AS sex, c.c_mktsegment AS seg,
         CASE WHEN c.c_nationkey = s.s_nationkey THEN 'RSD'
              WHEN cn.n_regionkey = sn.n_regionkey THEN 'WP' ELSE 'FLP' END AS loc,
         s.s_nationkey AS nat, sn.n_regionkey AS reg
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
),
smc AS (
  SELECT suppkey, month, cust, COUNT(*) AS lines_n, SUM(is_r) AS r_n, SUM(is_f) AS f_n, SUM(rev4) AS rev4,
         COUNT(DISTINCT ok) AS orders_n, MIN(sex) AS sex, MIN(seg) AS seg, MIN(loc) AS loc,
         MIN(nat) AS nat, MIN(reg) AS reg
  FROM lines GROUP BY suppkey, month, cust
),
smc2 AS (SELECT *, MIN(month) OVER (PARTITION BY suppkey, cust) AS first_m FROM smc),
sm0 AS (
  SELECT suppkey, month, SUM(rev4) / 10000.0::DOUBLE AS sales, SUM(rev4) AS rev4, SUM(orders_n) AS txn, COUNT(*) AS ncust,
    SUM(lines_n) AS lines, SUM(r_n) AS r_n, SUM(f_n) AS f_n,
    {_seg_cols()},
    SUM(CASE WHEN first_m = month THEN lines_n ELSE 0 END) AS _new,
    SUM(CASE WHEN first_m < month THEN lines_n ELSE 0 END) AS _reu,
    SUM(CASE WHEN loc = 'RSD' THEN lines_n ELSE 0 END) AS _rsd,
    SUM(CASE WHEN loc = 'WP' THEN lines_n ELSE 0 END) AS _wp,
    SUM(CASE WHEN loc = 'FLP' THEN lines_n ELSE 0 END) AS _flp,
    MIN(nat) AS nat, MIN(reg) AS reg
  FROM smc2 GROUP BY suppkey, month
),
sm AS (
  SELECT *, ROUND(sales / txn, 6) AS aov,
    (year(month) * 12 + month(month)) - (year(MIN(month) OVER (PARTITION BY suppkey)) * 12
      + month(MIN(month) OVER (PARTITION BY suppkey))) AS ops_months,
    {_share('r_n')} AS r_share, {_share('f_n')} AS f_share,
    year(month) * 12 + month(month) AS mi
  FROM sm0
),
ranked AS (
  SELECT *,
    percent_rank() OVER (PARTITION BY month ORDER BY sales) AS pr_sales,
    percent_rank() OVER (PARTITION BY month ORDER BY txn) AS pr_txn,
    percent_rank() OVER (PARTITION BY month ORDER BY ncust) AS pr_cust,
    percent_rank() OVER (PARTITION BY month ORDER BY aov) AS pr_aov,
    percent_rank() OVER (PARTITION BY month ORDER BY ops_months) AS pr_ops,
    percent_rank() OVER (PARTITION BY month ORDER BY r_share) AS pr_r,
    percent_rank() OVER (PARTITION BY nat, month ORDER BY sales DESC) AS pr_ind_sales,
    percent_rank() OVER (PARTITION BY reg, month ORDER BY sales DESC) AS pr_area_sales,
    100.0::DOUBLE * SUM(r_n) OVER (PARTITION BY nat, month) / SUM(lines) OVER (PARTITION BY nat, month) AS ind_r,
    SUM(rev4) OVER (PARTITION BY nat, month) / COUNT(*) OVER (PARTITION BY nat, month) / 10000.0::DOUBLE AS ind_avg_sales,
    AVG(txn) OVER (PARTITION BY nat, month) AS ind_avg_txn,
    100.0::DOUBLE * SUM(r_n) OVER (PARTITION BY reg, month) / SUM(lines) OVER (PARTITION BY reg, month) AS area_r
  FROM sm
),
ds2 AS (
  SELECT CAST(suppkey AS VARCHAR) AS ENCODED_MCT, strftime(month, '%Y%m') AS TA_YM,
    {_bin('pr_sales')} AS RC_M1_SAA, {_bin('pr_txn')} AS RC_M1_TO_UE_CT, {_bin('pr_cust')} AS RC_M1_UE_CUS_CN,
    {_bin('pr_aov')} AS RC_M1_AV_NP_AT, {cancel} AS APV_CE_RAT, {_bin('pr_ops')} AS MCT_OPE_MS_CN,
    f_share AS DLV_SAA_RAT,
    ROUND(100.0::DOUBLE * sales / ind_avg_sales, 6) AS M1_SME_RY_SAA_RAT,
    ROUND(100.0::DOUBLE * txn / ind_avg_txn, 6) AS M1_SME_RY_CNT_RAT,
    ROUND(100.0::DOUBLE * pr_ind_sales, 6) AS M12_SME_RY_SAA_PCE_RT,
    ROUND(100.0::DOUBLE * pr_area_sales, 6) AS M12_SME_BZN_SAA_PCE_RT,
    ROUND(ind_r, 6) AS M12_SME_RY_ME_MCT_RAT, ROUND(area_r, 6) AS M12_SME_BZN_ME_MCT_RAT
  FROM ranked
),
ds3 AS (
  SELECT CAST(suppkey AS VARCHAR) AS ENCODED_MCT, strftime(month, '%Y%m') AS TA_YM,
    {age},
    {_share('_reu')} AS MCT_UE_CLN_REU_RAT, {_share('_new')} AS MCT_UE_CLN_NEW_RAT,
    {_share('_rsd')} AS RC_M1_SHC_RSD_UE_CLN_RAT, {_share('_wp')} AS RC_M1_SHC_WP_UE_CLN_RAT,
    {_share('_flp')} AS RC_M1_SHC_FLP_UE_CLN_RAT
  FROM sm
),
ds1 AS (
  SELECT CAST(suppkey AS VARCHAR) AS ENCODED_MCT, CAST(MIN(nat) AS VARCHAR) AS HPSN_MCT_ZCD_NM,
    CAST(MIN(reg) AS VARCHAR) AS HPSN_MCT_BZN_CD_NM,
    CASE WHEN MAX(month) < (SELECT MAX(month) FROM sm) THEN CAST(MAX(month) + INTERVAL 1 MONTH AS DATE) END AS MCT_ME_D
  FROM sm GROUP BY suppkey
),
preds AS (
  SELECT CAST(suppkey AS VARCHAR) AS ENCODED_MCT, month AS TA_YM,
    {preds}
  FROM sm WHERE (suppkey * 7919 + mi) % 13 <> 0
)"""
