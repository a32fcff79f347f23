"""Cleaning and scalar-function queries (B1-B6, D1-D7) over the derived usage table.

Spelling variants of the bin labels, month strings and sentinel-coded values are derived from the
table's own values, so the work grows with the data."""
from __future__ import annotations

from pyspark.sql import functions as F

from storewatch.constants import KEY_MCT, KEY_YM
from storewatch.functions.bins import bin_rank, with_bin_rank_lenient
from storewatch.functions.core import (clip01, logistic, logit, nanmax, relu_minus, safe_null, to_percent,
                                       zero01)
from storewatch.functions.months import month_lenient, month_strict
from storewatch.operators.prepare import key_report
from storewatch.plans.catalog import panel, r6, register
from storewatch.plans.oracle_panel import panel_ctes
from storewatch.plans.oracle_risk import bin_rank as sql_bin_rank
from storewatch.plans.oracle_risk import clip01 as sql_clip01
from storewatch.plans.oracle_risk import logistic as sql_logistic
from storewatch.plans.oracle_risk import nanmax as sql_nanmax
from storewatch.plans.oracle_risk import relu_minus as sql_relu
from storewatch.plans.oracle_risk import to_pct as sql_to_pct
from storewatch.plans.oracle_risk import zero01 as sql_zero01


# --- B1 ----------------------------------------------------------------------------------------
def _sql_num(e: str) -> str:
    return (f"(CASE WHEN TRY_CAST({e} AS DOUBLE) <= -900000 OR isnan(TRY_CAST({e} AS DOUBLE)) THEN NULL "
            f"ELSE TRY_CAST({e} AS DOUBLE) END)")


@register("safe_null", f"""
WITH {panel_ctes()},
s AS (SELECT ENCODED_MCT, TA_YM, CASE WHEN DLV_SAA_RAT < 5 THEN -999999.0 ELSE DLV_SAA_RAT END AS dlv_coded,
  RC_M1_SAA, M1_SME_RY_SAA_RAT FROM ds2)
SELECT ENCODED_MCT, TA_YM, ROUND({_sql_num('dlv_coded')}, 6) AS dlv, {_sql_num('RC_M1_SAA')} AS saa_num,
  ROUND({_sql_num('M1_SME_RY_SAA_RAT')}, 6) AS ry_saa FROM s""")
def q_safe_null(spark, sf):
    u = panel(spark, sf).usage
    coded = F.when(F.col("DLV_SAA_RAT") < 5, F.lit(-999999.0)).otherwise(F.col("DLV_SAA_RAT"))
    return u.select(KEY_MCT, "TA_YM", F.round(safe_null(coded), 6).alias("dlv"),
                    safe_null("RC_M1_SAA").alias("saa_num"), F.round(safe_null("M1_SME_RY_SAA_RAT"), 6).alias("ry_saa"))


# --- B2 / B3 -----------------------------------------------------------------------------------
def _sql_month(e: str) -> str:
    fmts = ["%Y%m", "%Y-%m", "%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d", "%Y.%m"]
    parts = ", ".join(f"try_strptime(trim({e}), '{f}')" for f in fmts)
    return f"CAST(date_trunc('month', COALESCE({parts})) AS DATE)"


_MONTH_VARIANTS_SQL = """m AS (SELECT ENCODED_MCT, TA_YM AS m1, substr(TA_YM, 1, 4) || '-' || substr(TA_YM, 5, 2) AS m2,
  substr(TA_YM, 1, 4) || '-' || substr(TA_YM, 5, 2) || '-15' AS m3, 'x' || TA_YM AS m4 FROM ds2)"""


@register("month_coerce", f"""
WITH {panel_ctes()}, {_MONTH_VARIANTS_SQL}
SELECT ENCODED_MCT, m1, CAST(strptime(m1, '%Y%m') AS DATE) AS strict_m1, {_sql_month('m1')} AS lenient_m1,
  {_sql_month('m2')} AS lenient_m2, {_sql_month('m3')} AS lenient_m3, {_sql_month('m4')} AS lenient_m4 FROM m""")
def q_month_coerce(spark, sf):
    u = panel(spark, sf).usage
    m = u.select(KEY_MCT, F.col("TA_YM").alias("m1"),
                 F.concat(F.substring("TA_YM", 1, 4), F.lit("-"), F.substring("TA_YM", 5, 2)).alias("m2"),
                 F.concat(F.substring("TA_YM", 1, 4), F.lit("-"), F.substring("TA_YM", 5, 2), F.lit("-15")).alias("m3"),
                 F.concat(F.lit("x"), F.col("TA_YM")).alias("m4"))
    return m.select(KEY_MCT, "m1", month_strict("m1").alias("strict_m1"),
                    *[month_lenient(c).alias(f"lenient_{c}") for c in ("m1", "m2", "m3", "m4")])


# --- B5 / B6 -----------------------------------------------------------------------------------
def _variants():
    lab = F.col("RC_M1_SAA")
    pce = F.col("M12_SME_RY_SAA_PCE_RT")
    lo = (F.floor(pce / 10) * 10).cast("int")
    return {
        "v0": lab,
        "v1": F.replace(lab, F.lit("-"), F.lit(" ~ ")),
        "v2": F.replace(lab, F.lit("%"), F.lit("% ")),
        "v3": F.replace(lab, F.lit("이하"), F.lit("미만")),
        "v4": F.round(pce / 100, 4).cast("string"),
        "v5": F.concat(lo.cast("string"), F.lit("-"), (lo + 10).cast("string"), F.lit("%")),
        "v6": F.concat(F.floor(pce).cast("int").cast("string"), F.lit("%초과")),
        "v7": F.concat(F.floor(pce / 10).cast("int").cast("string"), F.lit("%이하")),
    }


_VARIANTS_SQL = """v AS (SELECT ENCODED_MCT, TA_YM, RC_M1_SAA AS v0, replace(RC_M1_SAA, '-', ' ~ ') AS v1,
  replace(RC_M1_SAA, '%', '% ') AS v2, replace(RC_M1_SAA, '이하', '미만') AS v3,
  CAST(ROUND(M12_SME_RY_SAA_PCE_RT / 100, 4) AS VARCHAR) AS v4,
  CAST(CAST(floor(M12_SME_RY_SAA_PCE_RT / 10) * 10 AS INTEGER) AS VARCHAR) || '-'
    || CAST(CAST(floor(M12_SME_RY_SAA_PCE_RT / 10) * 10 + 10 AS INTEGER) AS VARCHAR) || '%' AS v5,
  CAST(CAST(floor(M12_SME_RY_SAA_PCE_RT) AS INTEGER) AS VARCHAR) || '%초과' AS v6,
  CAST(CAST(floor(M12_SME_RY_SAA_PCE_RT / 10) AS INTEGER) AS VARCHAR) || '%이하' AS v7 FROM ds2)"""

_VN = [f"v{i}" for i in range(8)]


@register("bin_rank", f"""
WITH {panel_ctes()}, {_VARIANTS_SQL}
SELECT ENCODED_MCT, TA_YM, {", ".join(f"ROUND({sql_bin_rank(v)}, 6) AS r_{v}" for v in _VN)} FROM v""")
def q_bin_rank(spark, sf):
    u = panel(spark, sf).usage.withColumns(_variants())
    return u.select(KEY_MCT, "TA_YM", *[F.round(bin_rank(v), 6).alias(f"r_{v}") for v in _VN])


def _sql_lenient(e: str) -> str:
    from storewatch.constants import BIN2RANK
    norm = f"replace(replace(regexp_replace(trim({e}), '\\s', '', 'g'), '~', '-'), '미만', '이하')"
    body = f"replace({norm}, '%', '')"
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in BIN2RANK.items())
    lo = f"TRY_CAST(NULLIF(regexp_extract({body}, '^([0-9]{{1,3}})-?', 1), '') AS DOUBLE)"
    hi = f"TRY_CAST(NULLIF(regexp_extract({body}, '-([0-9]{{1,3}})$', 1), '') AS DOUBLE)"
    over = f"TRY_CAST(NULLIF(regexp_extract({norm}, '^([0-9]{{1,3}})%초과$', 1), '') AS DOUBLE) / 100.0"
    under = f"TRY_CAST(NULLIF(regexp_extract({norm}, '^([0-9]{{1,3}})%이하$', 1), '') AS DOUBLE) / 100.0"
    num = f"TRY_CAST(trim({e}) AS DOUBLE)"
    return f"""COALESCE(CASE {norm} {cases} END,
  CASE WHEN regexp_matches({norm}, '^[0-9]{{1,3}}-?[0-9]{{1,3}}%$') AND {lo} IS NOT NULL AND {hi} IS NOT NULL
    THEN LEAST(GREATEST(({lo} + {hi}) / 200.0, 0.0), 1.0) END,
  CASE WHEN regexp_matches({norm}, '^[0-9]{{1,3}}%초과$') THEN LEAST(0.95, GREATEST(0.90, {over} + 0.05)) END,
  CASE WHEN regexp_matches({norm}, '^[0-9]{{1,3}}%이하$') THEN GREATEST(0.05, LEAST(0.10, {under} - 0.05)) END,
  CASE WHEN isnan({num}) THEN NULL ELSE {num} END)"""


@register("bin_rank_lenient", f"""
WITH {panel_ctes()}, {_VARIANTS_SQL}
SELECT ENCODED_MCT, TA_YM, {", ".join(f"ROUND({_sql_lenient(v)}, 6) AS r_{v}" for v in _VN)} FROM v""")
def q_bin_rank_lenient(spark, sf):
    u = with_bin_rank_lenient(panel(spark, sf).usage.withColumns(_variants()), {f"r_{v}": v for v in _VN})
    return u.select(KEY_MCT, "TA_YM", *[F.round(f"r_{v}", 6).alias(f"r_{v}") for v in _VN])


# --- D1-D7 -------------------------------------------------------------------------------------
@register("scalar_math", f"""
WITH {panel_ctes()},
x AS (SELECT ENCODED_MCT, TA_YM, CASE WHEN RC_M1_SAA = '10%이하' THEN NULL
  ELSE (M12_SME_RY_SAA_PCE_RT - 50.0) / 25.0 END AS x, DLV_SAA_RAT AS pct, M1_SME_RY_SAA_RAT / 400.0 AS p FROM ds2)
SELECT ENCODED_MCT, TA_YM, ROUND({sql_clip01('x')}, 6) AS nz, ROUND({sql_zero01('x')}, 6) AS zero,
  ROUND({sql_relu('x')}, 6) AS relu_minus, ROUND({sql_logistic('x')}, 6) AS logistic,
  ROUND({sql_to_pct('pct')}, 6) AS to_percent, ROUND({sql_nanmax('x', 'p')}, 6) AS nanmax,
  ROUND(ln(LEAST(GREATEST(p, 0.000001), 0.999999) / (1 - LEAST(GREATEST(p, 0.000001), 0.999999))), 6) AS logit
FROM x""")
def q_scalar_math(spark, sf):
    u = panel(spark, sf).usage
    x = F.when(F.col("RC_M1_SAA") == "10%이하", F.lit(None).cast("double")).otherwise(
        (F.col("M12_SME_RY_SAA_PCE_RT") - 50.0) / 25.0)
    d = u.select(KEY_MCT, "TA_YM", x.alias("x"), F.col("DLV_SAA_RAT").alias("pct"),
                 (F.col("M1_SME_RY_SAA_RAT") / 400.0).alias("p"))
    return d.select(KEY_MCT, "TA_YM", F.round(clip01("x"), 6).alias("nz"), F.round(zero01("x"), 6).alias("zero"),
                    F.round(relu_minus("x"), 6).alias("relu_minus"), F.round(logistic(F.col("x")), 6).alias("logistic"),
                    F.round(to_percent("pct"), 6).alias("to_percent"), F.round(nanmax("x", "p"), 6).alias("nanmax"),
                    F.round(logit("p"), 6).alias("logit"))


@register("key_report", f"""WITH {panel_ctes()},
d1 AS (SELECT ENCODED_MCT AS k, NULL AS m FROM ds1 UNION ALL SELECT ENCODED_MCT, NULL FROM ds1 WHERE CAST(ENCODED_MCT AS BIGINT) % 4 = 0),
d2 AS (SELECT CASE WHEN CAST(ENCODED_MCT AS BIGINT) % 5 = 0 THEN NULL ELSE ENCODED_MCT END AS k,
    CASE WHEN CAST(ENCODED_MCT AS BIGINT) % 7 = 0 THEN NULL ELSE TA_YM END AS m FROM ds2),
u AS (SELECT 'merchants' AS input, k, m FROM d1 UNION ALL SELECT 'usage', k, m FROM d2
  UNION ALL SELECT 'customers', ENCODED_MCT, TA_YM FROM ds3),
g AS (SELECT input, k, m, COUNT(*) AS n FROM u GROUP BY 1, 2, 3)
SELECT input, SUM(n)::BIGINT AS n_rows, COALESCE(SUM(n) FILTER (WHERE k IS NULL), 0)::BIGINT AS no_store,
  CASE WHEN input <> 'merchants' THEN COALESCE(SUM(n) FILTER (WHERE m IS NULL), 0)::BIGINT ELSE 0 END AS no_month,
  COUNT(*) FILTER (WHERE k IS NOT NULL AND n > 1) AS repeated_keys,
  COALESCE(SUM(n - 1) FILTER (WHERE k IS NOT NULL), 0)::BIGINT AS surplus_rows FROM g GROUP BY input""")
def q_key_report(spark, sf):
    """Key problems of the three inputs, with merchants repeated, store keys and months broken on the way in."""
    p = panel(spark, sf)
    number = F.col(KEY_MCT).cast("long")
    merchants = p.merchants.unionByName(p.merchants.where(number % 4 == 0))
    usage = p.usage.withColumns({KEY_MCT: F.when(number % 5 != 0, F.col(KEY_MCT)),
                                 KEY_YM: F.when(number % 7 == 0, F.lit("n/a")).otherwise(F.col(KEY_YM))})
    return key_report({"merchants": merchants, "usage": usage, "customers": p.customers})
