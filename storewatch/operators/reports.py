"""Report aggregations: top-k, histogram, concentration, benchmark stats, usage stats, latest row."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewatch.constants import (ALPHA, BETA, EPS, EXPLAIN_CUSTOMER, EXPLAIN_DEFAULT, EXPLAIN_MARKET,
                                  EXPLAIN_SALES, GAMMA, KEY_MCT, KEY_YM)
from storewatch.operators.alerts import service_alert
from storewatch.operators.ranking import global_quantiles, group_quantiles


def top_k(df: DataFrame, score_col: str, k: int = 20, tie_cols: Sequence[str] = (KEY_MCT, KEY_YM)) -> DataFrame:
    """Highest ``k`` scores (ties broken by the key columns): a TakeOrdered, no full sort."""
    return df.orderBy(F.col(score_col).desc_nulls_last(), *[F.col(c).asc() for c in tie_cols]).limit(k)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram between the column's min and max (missing -> 0); last bin closed."""
    x = F.coalesce(F.col(col).cast("double"), F.lit(0.0))
    stats = df.select(x.alias("x"))
    lo = stats.select(F.min("x")).scalar()
    hi = stats.select(F.max("x")).scalar()
    width = hi - lo
    b = F.when(width <= 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - lo) / width * F.lit(float(bins))), F.lit(bins - 1))).cast("int")
    return (stats.select(b.alias("bin"), lo.alias("lo"), width.alias("width"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("width").alias("w"))
            .select("bin", "n", (F.col("lo") + F.col("bin") * F.col("w") / F.lit(float(bins))).alias("bin_lo")))


def hhi(df: DataFrame, group_cols: Sequence[str], weight_col: str) -> DataFrame:
    """Herfindahl index per group: sum((w / (sum w + EPS))^2), one aggregate (map-side combined)."""
    w = F.col(weight_col).cast("double")
    return df.groupBy(*group_cols).agg(
        (F.sum(w * w) / F.pow(F.sum(w) + F.lit(EPS), 2)).alias("hhi"), F.count(F.lit(1)).alias("n"))


def benchmark(df: DataFrame, metric: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """mean, median, p25, p75 and n of ``metric`` (per group when given), exact quantiles."""
    d = df.where(F.col(metric).isNotNull())
    if not group_cols:   # one row: quantiles as scalar subqueries, no join
        med, p25, p75 = global_quantiles(d, metric, [0.5, 0.25, 0.75])
        return d.agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("n")).select(
            "mean", med.alias("median"), p25.alias("p25"), p75.alias("p75"), "n")
    keys = list(group_cols)
    q = group_quantiles(d, keys, metric, [0.5, 0.25, 0.75], names=["median", "p25", "p75"])
    m = d.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("n"))
    return m.join(q, keys)


def usage_stats(events: DataFrame, days: int = 7, api_key=None) -> DataFrame:
    """Requests and mean response time per endpoint over the last ``days`` before the newest event
    ("now" is the data's own latest timestamp, never the wall clock)."""
    e = events.select(F.col("event_type").alias("endpoint"), F.col("value").alias("response_time"),
                      F.col("user_id").alias("api_key"), F.col("ts").cast("timestamp").alias("created_at"))
    now = e.select(F.max("created_at")).scalar()
    e = e.where(F.col("created_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    if api_key is not None:
        e = e.where(F.col("api_key") == F.lit(api_key))
    return e.groupBy("endpoint").agg(F.count(F.lit(1)).alias("count"),
                                      F.round(F.avg("response_time"), 3).alias("avg_response_time"))


def explanations(sales: Column, cust: Column, market: Column) -> Column:
    """Rule hits in fixed order, or the default sentence."""
    hits = F.filter(F.array(F.when(sales > 0.05, F.lit(EXPLAIN_SALES)), F.when(cust > 0.05, F.lit(EXPLAIN_CUSTOMER)),
                            F.when(market > 0.55, F.lit(EXPLAIN_MARKET))), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 0, F.array(F.lit(EXPLAIN_DEFAULT))).otherwise(hits)


def latest_per_store(risk: DataFrame, store: str = KEY_MCT, month: str = KEY_YM) -> DataFrame:
    """Newest month per store (NULL months ignored) with components, recomputed risk score, the service
    alert and explanations. One ``max_by`` aggregate: partial aggregation keeps hot stores cheap."""
    cols = ["Sales_Risk", "Customer_Risk", "Market_Risk", "p_model", "p_final"]
    latest = (risk.where(F.col(month).isNotNull())
              .groupBy(store)
              .agg(F.max_by(F.struct(month, *cols), F.col(month)).alias("r"))
              .select(store, "r.*"))
    s, c, m = (F.coalesce(F.col(x), F.lit(0.0)) for x in ("Sales_Risk", "Customer_Risk", "Market_Risk"))
    return latest.select(
        F.col(store).alias("store_id"), F.date_format(month, "yyyy-MM").alias("target_month"),
        s.alias("Sales_Risk"), c.alias("Customer_Risk"), m.alias("Market_Risk"),
        F.round(F.lit(ALPHA) * s + F.lit(BETA) * c + F.lit(GAMMA) * m, 6).alias("risk_score"),
        F.coalesce(F.col("p_model"), F.lit(0.0)).alias("p_model"), F.coalesce(F.col("p_final"), F.lit(0.0)).alias("p_final"),
        service_alert(F.coalesce(F.col("p_final"), F.lit(0.0))).alias("alert"),
        F.concat_ws(" | ", explanations(s, c, m)).alias("explanations"))


def minmax_invert(df: DataFrame, col: str, out: str = "score") -> DataFrame:
    """1 - (x - min) / (max - min + 1e-9)."""
    lo = df.select(F.min(col)).scalar()
    hi = df.select(F.max(col)).scalar()
    return df.withColumn(out, F.lit(1.0) - (F.col(col) - lo) / (hi - lo + F.lit(1e-9)))
