"""Report queries over the risk output and the raw tables (F1-F7, F10, G2, G3, E9, C8, C10)."""
from __future__ import annotations

from pyspark.sql import functions as F

from storewatch.constants import AGE_COLS, KEY_MCT, KEY_YM, TYPE_COLS
from storewatch.functions.core import col_or_default, zero01
from storewatch.operators.lookup import store_timeline
from storewatch.operators.ranking import with_percent_rank
from storewatch.operators.reports import (benchmark, hhi, histogram, latest_per_store, minmax_invert, top_k,
                                          usage_stats)
from storewatch.plans.catalog import panel, r6, register, scored
from storewatch.plans.oracle_panel import panel_ctes
from storewatch.plans.oracle_risk import scored_ctes, zero01 as sql_zero01
from storewatch.sources.tables import Tables

OUT = f"WITH {scored_ctes(True)}"
COMP = ["Sales_Risk", "Customer_Risk", "Market_Risk", "RiskScore", "p_model", "p_final"]


def _sql_r6(cols, p=""):
    return ", ".join(f"ROUND({p}{c}, 6) AS {c}" for c in cols)


@register("topk_risk", f"""{OUT}
SELECT ENCODED_MCT, TA_YM, {_sql_r6(COMP)}, Alert FROM alerted
ORDER BY p_final DESC, ENCODED_MCT, TA_YM LIMIT 20""")
def q_topk_risk(spark, sf):
    return top_k(scored(spark, sf), "p_final", 20).select(KEY_MCT, KEY_YM, *r6(*COMP), "Alert")


@register("store_timeline", f"""{OUT}
SELECT ENCODED_MCT, TA_YM, {_sql_r6(['p_final', 'RiskScore', 'Sales_Risk', 'Customer_Risk', 'Market_Risk'])}
FROM alerted""")
def q_store_timeline(spark, sf):
    """Every store's monthly timeline of the five plotted metrics (each store's rows, month order)."""
    s = store_timeline(scored(spark, sf))
    return s.select(KEY_MCT, KEY_YM, *r6("p_final", "RiskScore", "Sales_Risk", "Customer_Risk", "Market_Risk"))


@register("store_timeline_period", f"""{OUT},
pr AS (SELECT ENCODED_MCT, MIN(TA_YM) + INTERVAL 3 MONTH AS s, CASE WHEN CAST(ENCODED_MCT AS BIGINT) % 2 = 0
  THEN MIN(TA_YM) + INTERVAL 14 MONTH END AS e FROM alerted WHERE CAST(ENCODED_MCT AS BIGINT) % 5 <> 0 GROUP BY 1)
SELECT a.ENCODED_MCT, a.TA_YM, {_sql_r6(['p_final', 'RiskScore'], 'a.')} FROM alerted a JOIN pr ON a.ENCODED_MCT = pr.ENCODED_MCT
WHERE a.TA_YM >= pr.s AND (pr.e IS NULL OR a.TA_YM <= pr.e)""")
def q_store_timeline_period(spark, sf):
    """Timelines of many stores at once, each with a period of its own from a table (some open-ended)."""
    s = scored(spark, sf)
    number = F.col(KEY_MCT).cast("long")
    first = F.min(KEY_YM)
    periods = s.where(number % 5 != 0).groupBy(KEY_MCT).agg(
        F.add_months(first, 3).alias("start"), F.when(F.first(number) % 2 == 0, F.add_months(first, 14)).alias("end"))
    return store_timeline(s, periods=periods).select(KEY_MCT, KEY_YM, *r6("p_final", "RiskScore"))


@register("monthly_mean", f"""{OUT}
SELECT TA_YM, ROUND(AVG(p_final), 6) AS mean_p_final, ROUND(AVG(RiskScore), 6) AS mean_risk_score,
  COUNT(*) AS n FROM alerted GROUP BY TA_YM""")
def q_monthly_mean(spark, sf):
    return (scored(spark, sf).groupBy(KEY_YM)
            .agg(F.round(F.avg("p_final"), 6).alias("mean_p_final"), F.round(F.avg("RiskScore"), 6).alias("mean_risk_score"),
                 F.count(F.lit(1)).alias("n")))


@register("alert_counts", f"{OUT} SELECT Alert, COUNT(*) AS n FROM alerted GROUP BY Alert")
def q_alert_counts(spark, sf):
    return scored(spark, sf).groupBy("Alert").agg(F.count(F.lit(1)).alias("n"))


@register("score_histogram", f"""{OUT},
x AS (SELECT COALESCE(p_final, 0.0) AS x FROM alerted),
st AS (SELECT MIN(x) AS lo, MAX(x) - MIN(x) AS w FROM x)
SELECT CAST(CASE WHEN w <= 0 THEN 0 ELSE LEAST(floor((x - lo) / w * 30.0), 29) END AS INTEGER) AS bin, COUNT(*) AS n,
  ROUND(MIN(lo) + CAST(CASE WHEN w <= 0 THEN 0 ELSE LEAST(floor((x - lo) / w * 30.0), 29) END AS INTEGER) * MIN(w) / 30.0, 6)
  AS bin_lo
FROM x, st GROUP BY 1""")
def q_score_histogram(spark, sf):
    h = histogram(scored(spark, sf), "p_final", 30)
    return h.select("bin", "n", F.round("bin_lo", 6).alias("bin_lo"))


@register("hhi", f"""WITH {panel_ctes()}
SELECT CAST(nat AS VARCHAR) AS industry, month, ROUND(SUM(sales * sales) / POW(SUM(sales) + 0.000001, 2), 6) AS hhi,
  COUNT(*) AS n FROM sm GROUP BY nat, month""")
def q_hhi(spark, sf):
    sm = panel(spark, sf).store_month.withColumn("industry", F.col("nat").cast("string"))
    return hhi(sm, ["industry", "month"], "sales").select("industry", "month", F.round("hhi", 6).alias("hhi"), "n")


def _sq_sql(cols):
    return " + ".join(f"POW({sql_zero01(f'COALESCE({c}, 0) / 100.0')}, 2)" for c in cols)


@register("share_concentration", f"""WITH {panel_ctes()}
SELECT ENCODED_MCT, TA_YM, ROUND({_sq_sql(AGE_COLS)}, 6) AS h_age, ROUND({_sq_sql(TYPE_COLS)}, 6) AS h_type FROM ds3""")
def q_share_concentration(spark, sf):
    c = panel(spark, sf).customers

    def sq(cols):
        terms = [zero01(col_or_default(c, x, 0.0) / F.lit(100.0)) for x in cols]
        return sum([t * t for t in terms[1:]], terms[0] * terms[0])
    return c.select(KEY_MCT, KEY_YM, F.round(sq(AGE_COLS), 6).alias("h_age"), F.round(sq(TYPE_COLS), 6).alias("h_type"))


@register("benchmark", f"""{OUT},
g AS (SELECT a.p_final, m.HPSN_MCT_ZCD_NM AS industry FROM alerted a JOIN ds1 m ON a.ENCODED_MCT = m.ENCODED_MCT
  WHERE a.p_final IS NOT NULL)
SELECT 'ALL' AS industry, ROUND(AVG(p_final), 6) AS mean, ROUND(quantile_cont(p_final, 0.5), 6) AS median,
  ROUND(quantile_cont(p_final, 0.25), 6) AS p25, ROUND(quantile_cont(p_final, 0.75), 6) AS p75, COUNT(*) AS n FROM g
UNION ALL
SELECT industry, ROUND(AVG(p_final), 6), ROUND(quantile_cont(p_final, 0.5), 6), ROUND(quantile_cont(p_final, 0.25), 6),
  ROUND(quantile_cont(p_final, 0.75), 6), COUNT(*) FROM g GROUP BY industry""")
def q_benchmark(spark, sf):
    """Global statistics (the requested industry is echoed but not applied) plus per-industry rows."""
    s = scored(spark, sf).join(panel(spark, sf).merchants.select(KEY_MCT, F.col("HPSN_MCT_ZCD_NM").alias("industry")),
                               KEY_MCT)
    cols = [F.round(c, 6).alias(c) for c in ("mean", "median", "p25", "p75")]
    overall = benchmark(s, "p_final").select(F.lit("ALL").alias("industry"), *cols, "n")
    per = benchmark(s, "p_final", ["industry"]).select("industry", *cols, "n")
    return overall.unionByName(per)


@register("usage_stats", """
WITH e AS (SELECT event_type AS endpoint, value AS response_time, ts AS created_at FROM events)
SELECT endpoint, COUNT(*) AS count, ROUND(AVG(response_time), 3) AS avg_response_time FROM e
WHERE created_at >= (SELECT MAX(created_at) FROM e) - INTERVAL 7 DAY GROUP BY endpoint""")
def q_usage_stats(spark, sf):
    return usage_stats(Tables(spark, sf).events, days=7)


@register("minmax_invert", f"""{OUT}
SELECT ENCODED_MCT, TA_YM, ROUND(1 - (p_final - (SELECT MIN(p_final) FROM alerted))
  / ((SELECT MAX(p_final) FROM alerted) - (SELECT MIN(p_final) FROM alerted) + 1e-9), 6) AS score FROM alerted""")
def q_minmax_invert(spark, sf):
    return minmax_invert(scored(spark, sf), "p_final").select(KEY_MCT, KEY_YM, *r6("score"))


@register("peer_percentile", f"""{OUT}
SELECT a.ENCODED_MCT, a.TA_YM, m.HPSN_MCT_ZCD_NM AS industry, ROUND(a.p_final, 6) AS p_final,
  ROUND(percent_rank() OVER (PARTITION BY m.HPSN_MCT_ZCD_NM, a.TA_YM ORDER BY a.p_final), 6) AS industry_percentile
FROM alerted a JOIN ds1 m ON a.ENCODED_MCT = m.ENCODED_MCT""")
def q_peer_percentile(spark, sf):
    s = scored(spark, sf).join(panel(spark, sf).merchants.select(KEY_MCT, F.col("HPSN_MCT_ZCD_NM").alias("industry")),
                               KEY_MCT)
    pr = with_percent_rank(s, ["industry", KEY_YM], "p_final", "industry_percentile")
    return pr.select(KEY_MCT, KEY_YM, "industry", *r6("p_final", "industry_percentile"))


_EXPL_SQL = """concat_ws(' | ', CASE WHEN s > 0.05 OR c > 0.05 OR m > 0.55 THEN concat_ws(' | ',
  CASE WHEN s > 0.05 THEN '최근 1→3개월 대비 매출 모멘텀 둔화' END, CASE WHEN c > 0.05 THEN '고객 수 감소 신호' END,
  CASE WHEN m > 0.55 THEN '지역/업종 시장 위험도 상회' END) ELSE '위험 신호는 크지 않음' END)"""


@register("latest_risk", f"""{OUT},
l AS (SELECT ENCODED_MCT, arg_max(struct_pack(TA_YM, Sales_Risk, Customer_Risk, Market_Risk, p_model, p_final), TA_YM)
  AS r FROM alerted WHERE TA_YM IS NOT NULL GROUP BY ENCODED_MCT),
v AS (SELECT ENCODED_MCT AS store_id, strftime(r.TA_YM, '%Y-%m') AS target_month, COALESCE(r.Sales_Risk, 0) AS s,
  COALESCE(r.Customer_Risk, 0) AS c, COALESCE(r.Market_Risk, 0) AS m, COALESCE(r.p_model, 0) AS p_model,
  COALESCE(r.p_final, 0) AS p_final FROM l)
SELECT store_id, target_month, ROUND(s, 6) AS Sales_Risk, ROUND(c, 6) AS Customer_Risk, ROUND(m, 6) AS Market_Risk,
  ROUND(0.4 * s + 0.3 * c + 0.3 * m, 6) AS risk_score, ROUND(p_model, 6) AS p_model, ROUND(p_final, 6) AS p_final,
  CASE WHEN p_final >= 0.9 THEN 'RED' WHEN p_final >= 0.7 THEN 'ORANGE' ELSE 'GREEN' END AS alert,
  {_EXPL_SQL} AS explanations FROM v""")
def q_latest_risk(spark, sf):
    out = latest_per_store(scored(spark, sf))
    return out.select("store_id", "target_month", *r6("Sales_Risk", "Customer_Risk", "Market_Risk", "risk_score",
                                                        "p_model", "p_final"), "alert", "explanations")
