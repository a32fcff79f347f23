"""Request-table queries: validation, rule score, explanations, recommendations, stored-or-rule
fallback, history, batch and feedback summaries, per-store alert thresholds, trend, period report."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.constants import BASE_MARKET, KEY_MCT, KEY_YM
from storewatch.operators.factors import COMPONENT_WEIGHTS, TERMS, risk_factors
from storewatch.operators.prepare import load_and_join, normalize_bins
from storewatch.operators.quickscore import predict_or_score, quickscore, validate_requests
from storewatch.operators.trends import explain_factors, high_risk_stores, period_report, period_report_json, trend_forecast
from storewatch.operators.validate import validate_configs, validate_forecast_requests, validate_history_requests
from storewatch.operators.lookup import apply_thresholds, history
from storewatch.plans.catalog import panel, r6, register, scored
from storewatch.plans.oracle_panel import panel_ctes
from storewatch.plans.oracle_risk import r6s, scored_ctes, zero01
from storewatch.session import ensure_checkpoint_dir
from storewatch.streaming.streams import read_stream_like
from storewatch.streaming.tables import FeedbackTable, run_into
from storewatch.sources.requests import REQUEST_SQL, request_table


def _req(spark, sf):
    return request_table(panel(spark, sf))


def _qs(spark, sf):
    return quickscore(_req(spark, sf))


_BASE_CASE = "CASE industry_code " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in BASE_MARKET.items() if k != "default") + f" ELSE {BASE_MARKET['default']} END"


def _mom_sql(now: str, avg: str) -> str:
    return (f"CASE WHEN {now} IS NOT NULL AND {now} <> 0 AND {avg} IS NOT NULL AND {avg} <> 0 AND {avg} > 0 "
            f"THEN LEAST(GREATEST(-({now} - {avg}) / ({avg} + 1e-9), 0.0), 1.0) * 0.1 + 0.0 ELSE 0.0 END")


def _filtered(items: list, limit: int | None = None) -> str:
    f = f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
    return f"list_slice({f}, 1, {limit})" if limit else f


def _or_default(lst: str, default: str) -> str:
    return f"(CASE WHEN len({lst}) = 0 THEN ['{default}'] ELSE {lst} END)"


def expl_list_sql() -> str:
    from storewatch.constants import EXPLAIN_CUSTOMER, EXPLAIN_DEFAULT, EXPLAIN_MARKET, EXPLAIN_SALES
    return _or_default(_filtered([f"CASE WHEN Sales_Risk > 0.05 THEN '{EXPLAIN_SALES}' END",
                                  f"CASE WHEN Customer_Risk > 0.05 THEN '{EXPLAIN_CUSTOMER}' END",
                                  f"CASE WHEN Market_Risk > 0.55 THEN '{EXPLAIN_MARKET}' END"]), EXPLAIN_DEFAULT)


def rec_list_sql() -> str:
    from storewatch.constants import (RECOMMEND_CUSTOMER, RECOMMEND_DEFAULT, RECOMMEND_MARKET, RECOMMEND_RED,
                                      RECOMMEND_SALES)
    items = ([f"CASE WHEN Sales_Risk > 0.05 THEN '{t}' END" for t in RECOMMEND_SALES]
             + [f"CASE WHEN Customer_Risk > 0.05 THEN '{t}' END" for t in RECOMMEND_CUSTOMER]
             + [f"CASE WHEN Market_Risk > 0.55 THEN '{t}' END" for t in RECOMMEND_MARKET]
             + [f"CASE WHEN alert = 'RED' THEN '{RECOMMEND_RED}' END"])
    return _or_default(_filtered(items, 5), RECOMMEND_DEFAULT)


def _expl_sql() -> str:
    return f"array_to_string({expl_list_sql()}, ' | ')"


def _rec_sql() -> str:
    return f"array_to_string({rec_list_sql()}, ' | ')"


def qs_ctes(src: str) -> str:
    """Rule score CTEs ``rq0``/``rq1``/``rq`` over any relation with the request columns."""
    return f"""rq0 AS (SELECT *, {r6s(_mom_sql('sales_1m', 'sales_3m_avg'))} AS Sales_Risk,
  {r6s(_mom_sql('cust_1m', 'cust_3m_avg'))} AS Customer_Risk,
  {r6s(f"LEAST(GREATEST({_BASE_CASE} + CASE WHEN delivery_share IS NOT NULL THEN 0.02 * (delivery_share - 0.5) ELSE 0.0 END + CASE WHEN region_code LIKE '%구' THEN 0.002 ELSE 0.0 END, 0.45), 0.65)")} AS Market_Risk FROM {src}),
rq1 AS (SELECT *, 0.4 * Sales_Risk + 0.3 * Customer_Risk + 0.3 * Market_Risk AS sc FROM rq0),
rq AS (SELECT *, {r6s('sc')} AS risk_score, LEAST(GREATEST(sc, 0.0), 1.0) AS p_final,
  CASE WHEN LEAST(GREATEST(sc, 0.0), 1.0) >= 0.9 THEN 'RED' WHEN LEAST(GREATEST(sc, 0.0), 1.0) >= 0.7 THEN 'ORANGE'
  ELSE 'GREEN' END AS alert FROM rq1)"""


QS_SQL = f"""{REQUEST_SQL},
{qs_ctes('req')}"""


@register("validate_requests", f"""WITH {panel_ctes()}, {REQUEST_SQL}
SELECT store_id, target_month, len(r) = 0 AS valid, array_to_string(r, ',') AS reasons FROM (
  SELECT store_id, target_month, list_filter([
    CASE WHEN NOT (delivery_share IS NULL OR delivery_share BETWEEN 0 AND 1) THEN 'delivery_share' END,
    CASE WHEN NOT (sales_1m IS NULL OR sales_1m >= 0) THEN 'sales_1m' END,
    CASE WHEN NOT (sales_3m_avg IS NULL OR sales_3m_avg >= 0) THEN 'sales_3m_avg' END,
    CASE WHEN NOT (cust_1m IS NULL OR cust_1m >= 0) THEN 'cust_1m' END,
    CASE WHEN NOT (cust_3m_avg IS NULL OR cust_3m_avg >= 0) THEN 'cust_3m_avg' END,
    CASE WHEN NOT (target_month IS NULL OR regexp_full_match(target_month, '[0-9]{{4}}-(0[1-9]|1[0-2])'))
      THEN 'target_month' END], lambda x: x IS NOT NULL) AS r FROM req)""")
def q_validate_requests(spark, sf):
    v = validate_requests(_req(spark, sf))
    return v.select("store_id", "target_month", "valid", F.concat_ws(",", "reasons").alias("reasons"))


@register("quickscore", f"""WITH {panel_ctes()}, {QS_SQL}
SELECT store_id, target_month, Sales_Risk, Customer_Risk, Market_Risk, risk_score, {r6s('p_final')} AS p_final, alert
FROM rq""")
def q_quickscore(spark, sf):
    return _qs(spark, sf).select("store_id", "target_month", "Sales_Risk", "Customer_Risk", "Market_Risk", "risk_score",
                                 *r6("p_final"), "alert")


@register("explain", f"""WITH {panel_ctes()}, {QS_SQL}
SELECT store_id, target_month, {_expl_sql()} AS explanations FROM rq""")
def q_explain(spark, sf):
    return _qs(spark, sf).select("store_id", "target_month", F.concat_ws(" | ", "explanations").alias("explanations"))


@register("recommend", f"""WITH {panel_ctes()}, {QS_SQL}
SELECT store_id, target_month, {_rec_sql()} AS recommendations FROM rq""")
def q_recommend(spark, sf):
    return _qs(spark, sf).select("store_id", "target_month",
                                 F.concat_ws(" | ", "recommendations").alias("recommendations"))


_POS_SQL = f"""{scored_ctes(True)}, {REQUEST_SQL},
req2 AS (SELECT * FROM req UNION ALL SELECT DISTINCT store_id, '2099-01', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM req),
{qs_ctes('req2')},
st AS (SELECT ENCODED_MCT AS store_id, strftime(TA_YM, '%Y-%m') AS target_month, COALESCE(Sales_Risk, 0) AS s,
  COALESCE(Customer_Risk, 0) AS c, COALESCE(Market_Risk, 0) AS m, COALESCE(p_final, 0) AS spf FROM alerted),
pos AS (SELECT q.store_id, q.target_month,
  CASE WHEN st.store_id IS NOT NULL THEN 'model' WHEN (COALESCE(sales_1m, 0) <> 0 OR COALESCE(sales_3m_avg, 0) <> 0
    OR COALESCE(cust_1m, 0) <> 0 OR COALESCE(cust_3m_avg, 0) <> 0) THEN 'quick' ELSE 'not_found' END AS source,
  CASE WHEN st.store_id IS NOT NULL THEN ROUND(0.4 * s + 0.3 * c + 0.3 * m, 6) 
    WHEN COALESCE(sales_1m, 0) <> 0 OR COALESCE(sales_3m_avg, 0) <> 0 OR COALESCE(cust_1m, 0) <> 0 OR COALESCE(cust_3m_avg, 0) <> 0 THEN q.risk_score END AS risk_score,
  CASE WHEN st.store_id IS NOT NULL THEN spf WHEN COALESCE(sales_1m, 0) <> 0 OR COALESCE(sales_3m_avg, 0) <> 0 OR COALESCE(cust_1m, 0) <> 0
    OR COALESCE(cust_3m_avg, 0) <> 0 THEN q.p_final END AS p_final,
  CASE WHEN st.store_id IS NOT NULL THEN (CASE WHEN spf >= 0.9 THEN 'RED' WHEN spf >= 0.7 THEN 'ORANGE' ELSE 'GREEN' END)
    WHEN COALESCE(sales_1m, 0) <> 0 OR COALESCE(sales_3m_avg, 0) <> 0 OR COALESCE(cust_1m, 0) <> 0 OR COALESCE(cust_3m_avg, 0) <> 0 THEN q.alert END AS alert
  FROM rq q LEFT JOIN st ON q.store_id = st.store_id AND q.target_month = st.target_month)"""


def _pos(spark, sf):
    """Every request, and one of each store for a month that is not scored, without any figures."""
    req = _req(spark, sf)
    bare = req.select("store_id").distinct().select("store_id", F.lit("2099-01").alias("target_month"), *[
        F.lit(None).cast(f.dataType).alias(f.name) for f in req.schema.fields if f.name not in ("store_id", "target_month")])
    return predict_or_score(req.unionByName(bare), scored(spark, sf))


@register("predict_or_score", f"""WITH {_POS_SQL}
SELECT store_id, target_month, source, risk_score, ROUND(p_final, 6) AS p_final, alert FROM pos""")
def q_predict_or_score(spark, sf):
    return _pos(spark, sf).select("store_id", "target_month", "source", "risk_score", *r6("p_final"), "alert")


def _history(spark, sf):
    """Prediction history rows (rule scores appended with a timestamp derived from the request)."""
    q = _qs(spark, sf)
    return q.withColumn("created_at", F.to_timestamp(F.concat(F.col("target_month"), F.lit("-01"))))


@register("history", f"""WITH {panel_ctes()}, {QS_SQL},
h AS (SELECT store_id, target_month, p_final, alert, CAST(strptime(target_month || '-01', '%Y-%m-%d') AS TIMESTAMP)
  AS created_at FROM rq)
SELECT store_id, target_month, {r6s('p_final')} AS p_final, alert, created_at, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY created_at DESC) AS rn FROM h) WHERE rn <= 50""")
def q_history(spark, sf):
    """Newest 50 predictions per store. ``row_number() <= k`` lets Spark insert a per-partition group
    limit before the shuffle, so a hot store ships at most k rows per map task."""
    return history(_history(spark, sf), limit=50).select("store_id", "target_month", *r6("p_final"), "alert", "created_at", "rn")


@register("history_latest", f"""WITH {panel_ctes()}, {QS_SQL},
h AS (SELECT store_id, target_month, p_final, alert, CAST(strptime(target_month || '-01', '%Y-%m-%d') AS TIMESTAMP)
  AS created_at FROM rq)
SELECT store_id, target_month, {r6s('p_final')} AS p_final, alert, created_at FROM h
ORDER BY created_at DESC, store_id LIMIT 100""")
def q_history_latest(spark, sf):
    """Newest 100 predictions over all stores (no store filter): a TakeOrdered top-k."""
    from storewatch.operators.reports import top_k
    h = _history(spark, sf)
    return top_k(h, "created_at", 100, tie_cols=("store_id",)).select(
        "store_id", "target_month", *r6("p_final"), "alert", "created_at")


@register("history_range", f"""WITH {panel_ctes()}, {QS_SQL},
h AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY target_month DESC) AS rn,
  COUNT(*) OVER (PARTITION BY store_id) AS total_count FROM rq WHERE target_month BETWEEN '1996-01' AND '1998-12')
SELECT store_id, target_month, {r6s('p_final')} AS p_final, alert, rn, total_count, total_count > 24 AS has_more FROM h WHERE rn <= 24""")
def q_history_range(spark, sf):
    """Newest 24 records of three years per store, with the store's total and whether there are more."""
    h = history(_history(spark, sf), start="1996-01", end="1998-12", limit=24)
    return h.select("store_id", "target_month", *r6("p_final"), "alert", "rn", "total_count", "has_more")


@register("batch_analysis", f"""WITH {_POS_SQL}
SELECT target_month, COUNT(*) AS n, ROUND(AVG(p_final), 6) AS mean_p_final,
  COUNT(*) FILTER (WHERE alert = 'GREEN') AS n_green, COUNT(*) FILTER (WHERE alert = 'ORANGE') AS n_orange,
  COUNT(*) FILTER (WHERE alert = 'RED') AS n_red, COUNT(*) FILTER (WHERE source = 'model') AS n_model
FROM pos GROUP BY target_month""")
def q_batch_analysis(spark, sf):
    p = _pos(spark, sf)
    cnt = lambda cond: F.count(F.when(cond, F.lit(1)))
    return p.groupBy("target_month").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p_final"), 6).alias("mean_p_final"),
        cnt(F.col("alert") == "GREEN").alias("n_green"), cnt(F.col("alert") == "ORANGE").alias("n_orange"),
        cnt(F.col("alert") == "RED").alias("n_red"), cnt(F.col("source") == "model").alias("n_model"))


_FEEDBACK_SQL = """fb AS (SELECT store_id || '/' || target_month AS id, target_month, 5 - LEAST(4, CAST(floor(p_final * 10) AS INTEGER)) AS rating,
  CASE WHEN source = 'model' THEN 1 WHEN source = 'quick' THEN 0 END AS was_accurate FROM pos WHERE source <> 'not_found')"""


def _feedback_table(spark, sf):
    """The feedback of every answered request (rating from the score, accuracy from the answer's source), and one more of every third
    store with a rating out of range or no session, as a stream whose batches all come twice, in the feedback table."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/feedback/{uuid.uuid4().hex}"
    p = _pos(spark, sf).where("source <> 'not_found'")
    key = F.concat_ws("/", "store_id", "target_month")
    rating = F.lit(5) - F.least(F.lit(4), F.floor(F.col("p_final") * 10).cast("int"))
    rows = p.select(key.alias("id"), F.concat(F.lit("s"), F.col("store_id")).alias("session_id"), key.alias("prediction_id"), rating.alias("rating"),
                    F.lit("").alias("comment"), F.when(F.col("source") == "model", True).when(F.col("source") == "quick", False).alias("was_accurate"),
                    F.to_timestamp(F.concat("target_month", F.lit("-02"))).alias("created_at"), F.lit(None).cast("string").alias("api_key"))
    n = F.regexp_extract("session_id", "([0-9]+)", 1).cast("long")
    bad = rows.where(n % 3 == 0).withColumns({"id": F.concat(F.lit("bad/"), F.col("id")), "rating": F.when(n % 2 == 0, 9).otherwise(F.col("rating")),
                                              "session_id": F.when(n % 2 == 0, F.col("session_id"))})
    table = FeedbackTable(spark, f"{base}/table")

    def sink(batch, batch_id):
        table.append(batch, batch_id)
        table.append(batch, batch_id)

    run_into(read_stream_like(spark, rows.unionByName(bad), f"{base}/in", "created_at"), sink, f"{base}/_checkpoint")
    return table


@register("feedback_summary", f"""WITH {_POS_SQL}, {_FEEDBACK_SQL}
SELECT target_month, COUNT(*) AS n, ROUND(AVG(rating), 6) AS avg_rating, ROUND(AVG(was_accurate), 6) AS accuracy
FROM fb GROUP BY target_month""")
def q_feedback_summary(spark, sf):
    """The feedback table summarised per month of the prediction."""
    fb = _feedback_table(spark, sf).rows()
    return fb.groupBy(F.substring_index("prediction_id", "/", -1).alias("target_month")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("rating"), 6).alias("avg_rating"),
        F.round(F.avg(F.col("was_accurate").cast("int")), 6).alias("accuracy"))


@register("feedback_append", f"""WITH {_POS_SQL}, {_FEEDBACK_SQL}, k AS (SELECT *, CAST(split_part(id, '/', 1) AS BIGINT) AS s FROM fb)
SELECT id, rating, was_accurate, '' AS reasons FROM k
UNION ALL SELECT 'bad/' || id, CASE WHEN s % 2 = 0 THEN 9 ELSE rating END, was_accurate, CASE WHEN s % 2 = 0 THEN 'rating' ELSE 'session_id' END
FROM k WHERE s % 3 = 0""")
def q_feedback_append(spark, sf):
    """Accepted feedback, each once although every batch was written twice, and what was rejected, with the reasons."""
    table = _feedback_table(spark, sf)
    cols = ["id", "rating", F.col("was_accurate").cast("int").alias("was_accurate")]
    return table.rows().select(*cols, F.lit("").alias("reasons")).unionByName(
        table.rejected().select(*cols, F.concat_ws(",", "reasons").alias("reasons")))


@register("high_risk_stores", f"""WITH {_POS_SQL}
SELECT target_month, store_id, ROUND(p_final, 6) AS p_final, row_number() OVER (PARTITION BY target_month ORDER BY ROUND(p_final, 6) DESC, store_id) AS place
FROM pos WHERE ROUND(p_final, 6) >= 0.4""")
def q_high_risk_stores(spark, sf):
    """Stores of each month with a score of 0.4 or more, highest first."""
    p = _pos(spark, sf).withColumn("p_final", F.round("p_final", 6))
    return high_risk_stores(p).select("target_month", "store_id", "p_final", "place")


@register("validate_more", f"""WITH {panel_ctes()}, k AS (SELECT CAST(ENCODED_MCT AS BIGINT) AS s, ENCODED_MCT AS id FROM ds1)
SELECT 'config' AS shape, id, concat_ws(',', CASE WHEN s % 7 = 0 THEN 'orange' END, CASE WHEN s % 5 = 0 THEN 'red' END, CASE WHEN s % 4 = 1 THEN 'channels' END) AS reasons FROM k
UNION ALL SELECT 'history', id, concat_ws(',', CASE WHEN s % 3 = 0 THEN 'start' END, CASE WHEN s % 4 IN (0, 3) THEN 'limit' END,
  CASE WHEN s % 3 <> 0 AND s % 5 = 2 THEN 'period' END) FROM k
UNION ALL SELECT 'forecast', id, CASE WHEN s % 15 IN (0, 13, 14) THEN 'months_ahead' ELSE '' END FROM k""")
def q_validate_more(spark, sf):
    """Rules of alert configurations, history and forecast requests, on requests made from the stores, some of them broken."""
    m = panel(spark, sf).merchants.select(F.col(KEY_MCT).alias("store_id"), F.col(KEY_MCT).cast("long").alias("s"))
    s = F.col("s")
    configs = m.withColumns({"yellow": F.lit(None).cast("double"), "orange": F.when(s % 7 == 0, -0.1).otherwise(0.3), "red": F.when(s % 5 == 0, 1.5).otherwise(1.0),
                             "channels": F.when(s % 4 == 1, F.array(F.lit("email"), F.lit("fax"))).when(s % 4 == 2, F.array(F.lit("sms")))})
    asked = m.withColumns({"start": F.when(s % 3 == 0, "1996-13").when(s % 5 == 2, "1997-06"), "end": F.when(s % 5 == 2, "1997-01"),
                           "limit": F.when(s % 4 == 0, 0).when(s % 4 == 1, 1).when(s % 4 == 2, 1000).otherwise(1001)})
    asked = asked.withColumn("end", F.when(s % 3 != 0, F.col("end")))
    ahead = m.withColumn("months_ahead", (s % 15).cast("int"))
    parts = [("config", validate_configs(configs)), ("history", validate_history_requests(asked)), ("forecast", validate_forecast_requests(ahead))]
    return reduce(DataFrame.unionByName, [v.select(F.lit(n).alias("shape"), F.col("store_id").alias("id"), F.concat_ws(",", "reasons").alias("reasons"))
                                          for n, v in parts])


@register("custom_alerts", f"""WITH {scored_ctes(True)},
cfg AS (SELECT ENCODED_MCT, 0.15 AS yt, 0.25 AS ot, 0.35 AS rt FROM ds1
  WHERE MCT_ME_D IS NOT NULL AND CAST(ENCODED_MCT AS BIGINT) % 4 <> 0),
x AS (SELECT a.ENCODED_MCT, a.TA_YM, a.p_final, rt IS NOT NULL AS own,
  CASE WHEN a.p_final >= COALESCE(rt, 0.40) THEN 'RED' WHEN a.p_final >= COALESCE(ot, 0.30) THEN 'ORANGE'
  WHEN a.p_final >= COALESCE(yt, 0.20) THEN 'YELLOW' ELSE 'GREEN' END AS alert
  FROM alerted a LEFT JOIN cfg ON a.ENCODED_MCT = cfg.ENCODED_MCT)
SELECT ENCODED_MCT, TA_YM, ROUND(p_final, 6) AS p_final, alert, CASE WHEN own AND alert <> 'GREEN' THEN 'email,sms' ELSE '' END AS channels FROM x""")
def q_custom_alerts(spark, sf):
    """Per-store thresholds where a store has an enabled configuration (stores with a recorded close date watch
    with stricter ones; every fourth store has its own switched off), the default .20/.30/.40 elsewhere."""
    m = panel(spark, sf).merchants
    cfg = m.where(F.col("MCT_ME_D").isNotNull()).select(
        KEY_MCT, F.lit(0.15).alias("yellow"), F.lit(0.25).alias("orange"), F.lit(0.35).alias("red"),
        (F.col(KEY_MCT).cast("long") % 4 != 0).alias("enabled"), F.array(F.lit("email"), F.lit("sms")).alias("channels"))
    s = apply_thresholds(scored(spark, sf), cfg)
    return s.select(KEY_MCT, KEY_YM, *r6("p_final"), "alert", F.coalesce(F.concat_ws(",", "channels"), F.lit("")).alias("channels"))


@register("explain_factors", f"""WITH {scored_ctes(True)},
f AS (SELECT ENCODED_MCT, TA_YM, unnest(['Sales_Risk', 'Customer_Risk', 'Market_Risk']) AS component,
  unnest([Sales_Risk, Customer_Risk, Market_Risk]) AS value, unnest([0.4::DOUBLE, 0.3::DOUBLE, 0.3::DOUBLE]) AS weight FROM alerted)
SELECT ENCODED_MCT, TA_YM, component, {r6s('value')} AS value, {r6s('weight * value')} AS contribution,
  CASE WHEN value >= 0.5 THEN 'Critical' WHEN value >= 0.25 THEN 'High' WHEN value >= 0.1 THEN 'Medium' ELSE 'Low' END
  AS severity FROM f""")
def q_explain_factors(spark, sf):
    return explain_factors(scored(spark, sf)).select(KEY_MCT, KEY_YM, "component", *r6("value", "contribution"),
                                                     "severity")


@register("trend_forecast", f"""WITH {scored_ctes(True)},
x AS (SELECT ENCODED_MCT, year(TA_YM) * 12 + month(TA_YM) AS t, p_final FROM alerted),
fit AS (SELECT ENCODED_MCT, COALESCE(regr_slope(p_final, t), 0.0) AS b, MAX(t) AS last_t, COUNT(*) AS n,
  AVG(p_final) AS pbar, AVG(t) AS tbar FROM x GROUP BY ENCODED_MCT),
fit2 AS (SELECT *, pbar - b * tbar AS a FROM fit),
res AS (SELECT x.ENCODED_MCT, SQRT(AVG(POW(x.p_final - (a + b * x.t), 2))) AS sd FROM x JOIN fit2 f
  ON x.ENCODED_MCT = f.ENCODED_MCT GROUP BY x.ENCODED_MCT),
h AS (SELECT unnest([1, 2, 3]) AS h)
SELECT f.ENCODED_MCT AS store_id, h.h AS months_ahead,
  ROUND(LEAST(GREATEST(a + b * (last_t + h.h), 0.0), 1.0), 6) AS p_final,
  ROUND(LEAST(GREATEST(a + b * (last_t + h.h) - 1.96 * sd, 0.0), 1.0), 6) AS lower,
  ROUND(LEAST(GREATEST(a + b * (last_t + h.h) + 1.96 * sd, 0.0), 1.0), 6) AS upper,
  CASE WHEN b < -0.005 THEN 'improving' WHEN b > 0.005 THEN 'declining' ELSE 'stable' END AS trend
FROM fit2 f JOIN res r ON f.ENCODED_MCT = r.ENCODED_MCT CROSS JOIN h""")
def q_trend_forecast(spark, sf):
    out = trend_forecast(scored(spark, sf), months_ahead=3)
    return out.select("store_id", "months_ahead", *r6("p_final", "lower", "upper"), "trend")


@register("period_report", f"""WITH {scored_ctes(True)}
SELECT ENCODED_MCT AS store_id, COUNT(*) AS n_months, ROUND(AVG(p_final), 6) AS mean_p_final,
  ROUND(MAX(p_final), 6) AS max_p_final, COUNT(*) FILTER (WHERE Alert = 'RED') AS n_red,
  COUNT(*) FILTER (WHERE Alert IN ('RED', 'ORANGE')) AS n_orange_or_red, MIN(TA_YM) AS first_month,
  MAX(TA_YM) AS last_month
FROM alerted WHERE TA_YM BETWEEN DATE '1996-01-01' AND DATE '1998-12-01' GROUP BY ENCODED_MCT""")
def q_period_report(spark, sf):
    out = period_report(scored(spark, sf), "1996-01", "1998-12")
    return out.select("store_id", "n_months", *r6("mean_p_final", "max_p_final"), "n_red", "n_orange_or_red",
                      "first_month", "last_month")


_TERM_SQL = {"_s_drop": "s_drop", "_s_aov": "s_aov", "_s_cxl": "s_cxl", "_s_peer": zero01("(ind_rank + bzn_rank) / 2.0"), "_dlv * _jump": "dlv * jump",
             "_c_drop": "c_drop", "_c_loyal": "c_loyal", "_c_acq": "c_acq", "_c_mix": "c_mix", "_c_type": "c_type",
             "_m_closure": "m_closure", "_m_under": "m_under", "_m_age": "m_age"}


def _terms_sql() -> str:
    rows = [f"SELECT t.ENCODED_MCT, t.TA_YM, r.RiskScore, {i} AS place, '{c}' AS component, '{name}' AS factor, {_TERM_SQL[term]} AS value, "
            f"ROUND({COMPONENT_WEIGHTS[c] * w}::DOUBLE * ({_TERM_SQL[term]}), 9) AS part, '{text}' AS insight "
            "FROM terms t JOIN risks r ON t.ENCODED_MCT = r.ENCODED_MCT AND t.TA_YM = r.TA_YM" for i, (c, name, w, term, text) in enumerate(TERMS)]
    return "fx AS (" + " UNION ALL ".join(rows) + ")"


@register("risk_factors", f"""WITH {scored_ctes(True)}, {_terms_sql()}
SELECT ENCODED_MCT, TA_YM, component, factor, ROUND(value, 6) AS value, ROUND(part, 6) AS contribution, 1 AS adds_up FROM fx""")
def q_risk_factors(spark, sf):
    """The thirteen terms behind every RiskScore; their contributions add up to it."""
    f = _factors(spark, sf)
    total = F.aggregate("factors", F.lit(0.0), lambda a, x: a + x["contribution"])
    f = f.withColumn("adds_up", (F.abs(total - F.col("RiskScore")) < 1e-9).cast("int"))
    f = f.select(KEY_MCT, KEY_YM, "adds_up", F.explode_outer("factors").alias("f")).select(KEY_MCT, KEY_YM, "f.*", "adds_up")   # never empty; outer: no filter that makes the terms again
    return f.select(KEY_MCT, KEY_YM, "component", "factor", *r6("value"), F.round(F.round("contribution", 9), 6).alias("contribution"), "adds_up")


def _factors(spark, sf):
    p = panel(spark, sf)
    return risk_factors(normalize_bins(load_and_join(p.merchants, p.usage, p.customers)))


@register("risk_insights", f"""WITH {scored_ctes(True)}, {_terms_sql()},
k AS (SELECT *, row_number() OVER (PARTITION BY ENCODED_MCT, TA_YM ORDER BY part DESC, place) AS rn FROM fx)
SELECT ENCODED_MCT, TA_YM, ROUND(any_value(RiskScore), 6) AS RiskScore, CASE WHEN any_value(RiskScore) >= 0.5 THEN 'Critical'
  WHEN any_value(RiskScore) >= 0.25 THEN 'High' WHEN any_value(RiskScore) >= 0.1 THEN 'Medium' ELSE 'Low' END AS severity,
  any_value(factor) FILTER (WHERE rn = 1) AS top_factor,
  coalesce(string_agg(insight, ' | ' ORDER BY rn) FILTER (WHERE rn <= 3 AND part >= 0.02), '') AS insights FROM k GROUP BY ENCODED_MCT, TA_YM""")
def q_risk_insights(spark, sf):
    """Severity, the largest factor and what to look at first, of every store-month."""
    return _factors(spark, sf).select(KEY_MCT, KEY_YM, *r6("RiskScore"), "severity", F.col("factors")[0]["factor"].alias("top_factor"),
                                      F.concat_ws(" | ", "insights").alias("insights"))


@register("period_report_json", f"""WITH {scored_ctes(True)}, n AS (SELECT *, CAST(ROUND(p_final, 6) AS DECIMAL(18, 6)) AS p, CAST(ROUND(RiskScore, 6) AS DECIMAL(18, 6)) AS r
  FROM alerted WHERE TA_YM BETWEEN DATE '1996-01-01' AND DATE '1998-12-01')
SELECT ENCODED_MCT AS store_id, '{{"store_id":"' || ENCODED_MCT || '","summary":{{"n_months":' || COUNT(*) || ',"mean_p_final":'
  || CAST(ROUND(AVG(p_final), 6) AS DECIMAL(18, 6)) || ',"max_p_final":' || MAX(p) || ',"n_red":' || COUNT(*) FILTER (WHERE Alert = 'RED')
  || ',"n_orange_or_red":' || COUNT(*) FILTER (WHERE Alert IN ('RED', 'ORANGE')) || ',"first_month":"' || strftime(MIN(TA_YM), '%Y-%m')
  || '","last_month":"' || strftime(MAX(TA_YM), '%Y-%m') || '"}},"months":[' || string_agg('{{"month":"' || strftime(TA_YM, '%Y-%m') || '","p_final":' || p
  || ',"RiskScore":' || r || ',"alert":"' || Alert || '"}}', ',' ORDER BY TA_YM) || ']}}' AS content FROM n GROUP BY ENCODED_MCT""")
def q_period_report_json(spark, sf):
    """The three-year report of every store as JSON."""
    return period_report_json(scored(spark, sf), "1996-01", "1998-12")
