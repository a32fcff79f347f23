"""Request scoring without a model: rule risks from the request's own numbers, service alert,
explanations and recommendations; stored-score lookup with rule fallback; request validation."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewatch.constants import (ALPHA, BASE_MARKET, BETA, GAMMA, KEY_MCT, KEY_YM, RECOMMEND_CUSTOMER,
                                  RECOMMEND_DEFAULT, RECOMMEND_MARKET, RECOMMEND_RED, RECOMMEND_SALES)
from storewatch.operators.alerts import service_alert
from storewatch.operators.reports import explanations

METRICS = ["sales_1m", "sales_3m_avg", "cust_1m", "cust_3m_avg"]


def _given(c: Column) -> Column:
    """Truthiness of an optional number: present and non-zero (zero counts as not given)."""
    return c.isNotNull() & (c != 0)


def _momentum_risk(now: Column, avg: Column) -> Column:
    ok = _given(now) & _given(avg) & (avg > 0)
    drop = -(now - avg) / (avg + F.lit(1e-9))
    return F.when(ok, F.least(F.greatest(drop, F.lit(0.0)), F.lit(1.0)) * F.lit(0.1)).otherwise(F.lit(0.0))


def market_quick(industry: Column, region: Column, share: Column) -> Column:
    base_map = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in BASE_MARKET.items()))
    base = F.coalesce(F.element_at(base_map, F.coalesce(industry, F.lit("default"))), F.lit(BASE_MARKET["default"]))
    base = base + F.when(share.isNotNull(), F.lit(0.02) * (share - F.lit(0.5))).otherwise(F.lit(0.0))
    base = base + F.when(region.isNotNull() & region.endswith("구"), F.lit(0.002)).otherwise(F.lit(0.0))
    return F.least(F.greatest(base, F.lit(0.45)), F.lit(0.65))


def recommendations(sales: Column, cust: Column, market: Column, alert: Column) -> Column:
    """Advice pairs per rule hit, then the RED message; first five, or the default line."""
    def pair(cond, texts):
        return [F.when(cond, F.lit(t)) for t in texts]
    items = F.array(*pair(sales > 0.05, RECOMMEND_SALES), *pair(cust > 0.05, RECOMMEND_CUSTOMER),
                    *pair(market > 0.55, RECOMMEND_MARKET), F.when(alert == "RED", F.lit(RECOMMEND_RED)))
    hits = F.slice(F.filter(items, lambda x: x.isNotNull()), 1, 5)
    return F.when(F.size(hits) == 0, F.array(F.lit(RECOMMEND_DEFAULT))).otherwise(hits)


def quickscore(req: DataFrame) -> DataFrame:
    """Adds Sales_Risk, Customer_Risk, Market_Risk (6 digits), risk_score, p_model = 0, p_final, alert,
    explanations and recommendations (arrays) to a request table."""
    d = req.withColumns({
        "Sales_Risk": F.round(_momentum_risk(F.col("sales_1m"), F.col("sales_3m_avg")), 6),
        "Customer_Risk": F.round(_momentum_risk(F.col("cust_1m"), F.col("cust_3m_avg")), 6),
        "Market_Risk": F.round(market_quick(F.col("industry_code"), F.col("region_code"), F.col("delivery_share")), 6),
    })
    score = F.lit(ALPHA) * F.col("Sales_Risk") + F.lit(BETA) * F.col("Customer_Risk") + F.lit(GAMMA) * F.col("Market_Risk")
    d = d.withColumns({"_score": score, "p_model": F.lit(0.0)})
    d = d.withColumns({"risk_score": F.round("_score", 6),
                       "p_final": F.least(F.greatest(F.col("_score"), F.lit(0.0)), F.lit(1.0))})
    d = d.withColumn("alert", service_alert(F.col("p_final")))
    d = d.withColumn("explanations", explanations(F.col("Sales_Risk"), F.col("Customer_Risk"), F.col("Market_Risk")))
    d = d.withColumn("recommendations", recommendations(F.col("Sales_Risk"), F.col("Customer_Risk"),
                                                        F.col("Market_Risk"), F.col("alert")))
    return d.drop("_score")


def predict_or_score(req: DataFrame, risk: DataFrame) -> DataFrame:
    """Stored score for (store, month) if present, else the rule score when any metric is given, else a
    not-found row. One left join on the request key (both sides shuffle on the key)."""
    stored = risk.select(F.col(KEY_MCT).alias("store_id"), F.date_format(KEY_YM, "yyyy-MM").alias("target_month"),
                         *[F.col(c).alias(f"_st_{c}") for c in ("Sales_Risk", "Customer_Risk", "Market_Risk",
                                                                 "p_model", "p_final")], F.lit(True).alias("_found"))
    q = quickscore(req).join(stored, ["store_id", "target_month"], "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    any_metric = None
    for m in METRICS:
        g = _given(F.col(m))
        any_metric = g if any_metric is None else (any_metric | g)
    source = F.when(found, "model").when(any_metric, "quick").otherwise("not_found")
    s, c, m = (F.coalesce(F.col(f"_st_{x}"), F.lit(0.0)) for x in ("Sales_Risk", "Customer_Risk", "Market_Risk"))
    st_score = F.round(F.lit(ALPHA) * s + F.lit(BETA) * c + F.lit(GAMMA) * m, 6)
    st_pf = F.coalesce(F.col("_st_p_final"), F.lit(0.0))
    out = q.withColumn("source", source)
    return out.select(
        "store_id", "target_month", "source",
        F.when(found, st_score).when(F.col("source") == "quick", F.col("risk_score")).alias("risk_score"),
        F.when(found, st_pf).when(F.col("source") == "quick", F.col("p_final")).alias("p_final"),
        F.when(found, service_alert(st_pf)).when(F.col("source") == "quick", F.col("alert")).alias("alert"))


def validate_requests(req: DataFrame) -> DataFrame:
    """Adds ``reasons`` (array of failed rules) and ``valid``; rows are never dropped."""
    ym_ok = F.col("target_month").isNull() | F.col("target_month").rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$")
    checks = [
        (F.col("delivery_share").isNull() | F.col("delivery_share").between(0.0, 1.0), "delivery_share"),
        (F.col("sales_1m").isNull() | (F.col("sales_1m") >= 0), "sales_1m"),
        (F.col("sales_3m_avg").isNull() | (F.col("sales_3m_avg") >= 0), "sales_3m_avg"),
        (F.col("cust_1m").isNull() | (F.col("cust_1m") >= 0), "cust_1m"),
        (F.col("cust_3m_avg").isNull() | (F.col("cust_3m_avg") >= 0), "cust_3m_avg"),
        (ym_ok, "target_month"),
    ]
    reasons = F.filter(F.array(*[F.when(~ok, F.lit(name)) for ok, name in checks]), lambda x: x.isNotNull())
    return req.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)
