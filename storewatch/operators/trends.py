"""Declared report shapes: component factor breakdown, per-store trend forecast, period summary.
The cut-offs here are this library's own (the declared schemas give no rule)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.constants import ALPHA, BETA, GAMMA, KEY_MCT, KEY_YM
from storewatch.operators.ranking import value_ranks

SEVERITY_CUTS = [(0.5, "Critical"), (0.25, "High"), (0.1, "Medium")]


def severity(v) -> F.Column:
    expr = None
    for cut, name in SEVERITY_CUTS:
        expr = F.when(v >= cut, name) if expr is None else expr.when(v >= cut, name)
    return expr.otherwise("Low")


def explain_factors(risk: DataFrame) -> DataFrame:
    """One row per (store, month, component): value, weighted contribution, severity."""
    comps = F.array(*[F.struct(F.lit(n).alias("component"), F.col(n).alias("value"), F.lit(w).alias("weight"))
                      for n, w in (("Sales_Risk", ALPHA), ("Customer_Risk", BETA), ("Market_Risk", GAMMA))])
    d = risk.select(KEY_MCT, KEY_YM, F.explode(comps).alias("f")).select(KEY_MCT, KEY_YM, "f.*")
    return d.withColumns({"contribution": F.col("weight") * F.col("value"), "severity": severity(F.col("value"))})


def trend_forecast(risk: DataFrame, months_ahead: int = 3, flat: float = 0.005) -> DataFrame:
    """Least-squares line of p_final over the month index per store, extrapolated 1..months_ahead with a
    +-1.96 residual-sd band; slope below -flat = improving, above +flat = declining."""
    if not 1 <= months_ahead <= 12:
        raise ValueError("months_ahead must be within 1..12")
    x = risk.select(KEY_MCT, (F.year(KEY_YM) * 12 + F.month(KEY_YM)).cast("double").alias("t"), "p_final")
    fit = (x.groupBy(KEY_MCT).agg(F.coalesce(F.regr_slope("p_final", "t"), F.lit(0.0)).alias("b"),
                                  F.max("t").alias("last_t"), F.avg("p_final").alias("pbar"), F.avg("t").alias("tbar"))
           .withColumn("a", F.col("pbar") - F.col("b") * F.col("tbar")))
    res = (x.join(fit.select(KEY_MCT, "a", "b"), KEY_MCT)
           .groupBy(KEY_MCT).agg(F.sqrt(F.avg(F.pow(F.col("p_final") - (F.col("a") + F.col("b") * F.col("t")), 2)))
                                 .alias("sd")))
    f = fit.join(res, KEY_MCT).withColumn("months_ahead", F.explode(F.sequence(F.lit(1), F.lit(months_ahead))))
    mid = F.col("a") + F.col("b") * (F.col("last_t") + F.col("months_ahead"))

    def clip(c):
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    trend = F.when(F.col("b") < -flat, "improving").when(F.col("b") > flat, "declining").otherwise("stable")
    return f.select(F.col(KEY_MCT).alias("store_id"), "months_ahead", clip(mid).alias("p_final"),
                    clip(mid - F.lit(1.96) * F.col("sd")).alias("lower"),
                    clip(mid + F.lit(1.96) * F.col("sd")).alias("upper"), trend.alias("trend"))


def period_report(risk: DataFrame, start: str, end: str) -> DataFrame:
    """Per store over months [start, end] (yyyy-MM): months, mean / max score, alert counts, span."""
    d = risk.where(F.col(KEY_YM).between(F.to_date(F.lit(start + "-01")), F.to_date(F.lit(end + "-01"))))
    return d.groupBy(F.col(KEY_MCT).alias("store_id")).agg(
        F.count(F.lit(1)).alias("n_months"), F.avg("p_final").alias("mean_p_final"), F.max("p_final").alias("max_p_final"),
        F.count(F.when(F.col("Alert") == "RED", 1)).alias("n_red"),
        F.count(F.when(F.col("Alert").isin("RED", "ORANGE"), 1)).alias("n_orange_or_red"),
        F.min(KEY_YM).alias("first_month"), F.max(KEY_YM).alias("last_month"))


def period_report_json(risk: DataFrame, start: str, end: str) -> DataFrame:
    """The period report of a store as one JSON text: its summary and its months in order (numbers with six decimals)."""
    number = lambda c: F.round(F.col(c), 6).cast("decimal(18,6)").alias(c)
    text = lambda c: F.date_format(c, "yyyy-MM").alias(c)
    d = risk.where(F.col(KEY_YM).between(F.to_date(F.lit(start + "-01")), F.to_date(F.lit(end + "-01"))))
    months = d.groupBy(F.col(KEY_MCT).alias("store_id")).agg(F.sort_array(F.collect_list(F.struct(
        F.date_format(KEY_YM, "yyyy-MM").alias("month"), number("p_final"), number("RiskScore"), F.col("Alert").alias("alert")))).alias("months"))
    summary = period_report(risk, start, end).select("store_id", F.struct(
        "n_months", number("mean_p_final"), number("max_p_final"), "n_red", "n_orange_or_red", text("first_month"), text("last_month")).alias("summary"))
    return summary.join(months, "store_id").select("store_id", F.to_json(F.struct("store_id", "summary", "months")).alias("content"))


def high_risk_stores(scores: DataFrame, threshold: float = 0.4) -> DataFrame:
    """The stores of each month whose score reaches the threshold, highest first (``place`` within the month; ties by store).

    Places come from :func:`value_ranks`, so a month is spread over many tasks; rows that repeat have places of their own."""
    nan = F.isnan("p_final")
    key = F.struct((~nan).alias("number"), (-F.col("p_final")).alias("less"), "store_id")   # ascending = highest first, NaN before all
    high = scores.where(F.col("p_final") >= threshold).select(F.struct("target_month").alias("_month"), key.alias("_key"))
    ranks = value_ranks(high, ["_month"], "_key")
    return ranks.select("_month.target_month", "_key.store_id", (F.lit(0.0) - F.col("_key.less")).alias("p_final"),
                        F.explode(F.sequence((F.col("lt") + 1).cast("int"), (F.col("lt") + F.col("n")).cast("int"))).alias("place"))
