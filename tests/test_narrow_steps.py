"""Shared steps of the risk table at size: narrow rows are shuffled, rolling scores are made a batch at a time."""
import datetime as dt
import random

from pyspark.sql import functions as F

from data_paths import SF_SMALL
from storewatch.operators.windows import store_window, with_robust_z, with_robust_z_scores
from storewatch.session import spread
from storewatch.sources.panel import store_month
from storewatch.sources.tables import Tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_are_those_of_the_windows(spark):
    """Same z scores, bit for bit, with missing and NaN values, a store without a name and histories cut by batches of seven rows."""
    r, name = random.Random(1), "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = [(None if i == 9 else str(i), dt.date(2000 + m // 12, 1 + m % 12, 1),
             None if r.random() < 0.2 else float("nan") if r.random() < 0.03 else round(r.random(), 1), r.random())
            for i in range(12) for m in range(r.choice([1, 5, 6, 13, 60]))]
    df = spark.createDataFrame(rows, "ENCODED_MCT string, TA_YM date, x double, y double")
    specs, cols = {"a": F.col("x"), "b": F.col("y")}, ["ENCODED_MCT", "TA_YM", "a_x", "a_z", "b_z"]
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        got = with_robust_z_scores(df, specs, "ENCODED_MCT", ["TA_YM"]).select(cols).collect()
    finally:
        spark.conf.set(name, before)
    want = with_robust_z(df, specs, store_window()).select(cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_rows_of_lines_travel_narrow(spark):
    """The counts of a store-month are made after its rows have met: no wide partial sums are shuffled, and stores are not joined by a shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(store_month(Tables(spark, SF_SMALL)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    to_month = [x for x in plan.splitlines() if "Exchange hashpartitioning(suppkey" in x and "month" in x]
    assert len(to_month) == 1 and "REPARTITION" in to_month[0]
    assert "hashpartitioning(l_suppkey" not in plan


def test_spread_always_deals(spark):
    df = spark.range(100)
    assert spread(df, 100, "id") is df
    assert "REPARTITION_BY_COL" in _plan(spread(df, 100, "id", always=True))
