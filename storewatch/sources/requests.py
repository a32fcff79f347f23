"""Scoring requests and chat utterances derived from the store-month table.

The service side scores one request or one chat message at a time; here requests are a table (one per
store-month, asking about the following month), so the same rules run as one distributed job.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storewatch.sources.panel import Panel

# fixed fixture rule: supplier nation -> industry keyword (cycled), region suffix by nation parity
INDUSTRY_CYCLE = ["치킨", "카페", "피자", "편의점", "분식"]


def request_table(p: Panel) -> DataFrame:
    sm = p.store_month
    w = Window.partitionBy("suppkey").orderBy("month").rowsBetween(-2, 0)   # one store's months
    cycle = F.array(*[F.lit(x) for x in INDUSTRY_CYCLE])
    return sm.select(
        F.col("suppkey").cast("string").alias("store_id"),
        F.date_format(F.add_months("month", 1), "yyyy-MM").alias("target_month"),
        F.concat(F.lit("R"), F.col("reg").cast("string"),
                 F.when(F.col("nat") % 2 == 0, F.lit("구")).otherwise(F.lit("동"))).alias("region_code"),
        F.element_at(cycle, (F.col("nat") % len(INDUSTRY_CYCLE) + 1).cast("int")).alias("industry_code"),
        F.round((F.lit(100.0) * F.col("f_n") / F.col("lines") - F.lit(5.0)) / F.lit(100.0), 6).alias("delivery_share"),
        F.col("sales").alias("sales_1m"),
        F.round(F.avg("sales").over(w), 4).alias("sales_3m_avg"),
        F.col("ncust").cast("double").alias("cust_1m"),
        F.round(F.avg("ncust").over(w), 6).alias("cust_3m_avg"),
    )


REQUEST_SQL = """req AS (
  SELECT CAST(suppkey AS VARCHAR) AS store_id, strftime(month + INTERVAL 1 MONTH, '%Y-%m') AS target_month,
    'R' || CAST(reg AS VARCHAR) || CASE WHEN nat % 2 = 0 THEN '구' ELSE '동' END AS region_code,
    (['치킨', '카페', '피자', '편의점', '분식'])[CAST(nat % 5 + 1 AS INTEGER)] AS industry_code,
    ROUND((100.0::DOUBLE * f_n / lines - 5.0) / 100.0, 6) AS delivery_share,
    sales AS sales_1m,
    ROUND(AVG(sales) OVER (PARTITION BY suppkey ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS sales_3m_avg,
    CAST(ncust AS DOUBLE) AS cust_1m,
    ROUND(AVG(ncust) OVER (PARTITION BY suppkey ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS cust_3m_avg
  FROM sm)"""


def utterance_table(requests: DataFrame) -> DataFrame:
    """One Korean chat message per request, written from its values (three phrasings)."""
    man = lambda c: F.format_string("%d", F.round(F.col(c) / 10000).cast("long"))
    delivery = (F.when(F.col("delivery_share") >= 0.6, F.lit("배달 위주"))
                .when(F.col("delivery_share") < 0.2, F.lit("홀 위주"))
                .otherwise(F.concat(F.lit("배달 "), F.format_string("%d", F.round(F.col("delivery_share") * 100)
                                                                       .cast("long")), F.lit("%"))))
    kind = (F.substring("target_month", 1, 4).cast("int") * 12 + F.substring("target_month", 6, 2).cast("int")) % 3
    text = (F.when(kind == 0, F.concat(F.col("industry_code"), F.lit("집 "), F.col("region_code"),
                                       F.lit("에서 지난달 매출 "), man("sales_1m"), F.lit("만원, 최근 3개월 평균 "),
                                       man("sales_3m_avg"), F.lit("만원, "), delivery))
            .when(kind == 1, F.concat(F.col("region_code"), F.lit(" "), F.col("industry_code"), F.lit(" 가게, 지난달 고객 "),
                                      F.format_string("%d", F.col("cust_1m").cast("long")), F.lit("명, 매출 "),
                                      man("sales_1m"), F.lit("만원")))
            .otherwise(F.concat(F.lit("한 달 "), man("sales_1m"), F.lit("만원 벌었어요. "), delivery)))
    return requests.select(F.col("store_id").alias("session_id"), "target_month", text.alias("message"))
