"""Steps that must not be worked out again for every question asked of them."""
import datetime as dt

from pyspark.sql import functions as F

from storewatch.operators.labels import label_cascade, stratified_split


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def months(n):
    return [dt.date(2024, 1 + i, 1) for i in range(n)]


def test_cascade_returns_the_written_labels(spark):
    """What the cascade asks of a source and what it returns are one written table, whichever source is taken."""
    keys = "ENCODED_MCT string, TA_YM date, RC_M1_SAA string, RC_M1_UE_CUS_CN string, APV_CE_RAT double"
    base = spark.createDataFrame([(s, m, "25-50%", "25-50%", 95.0 * (s == "a")) for s in "abc" for m in months(4)], keys)
    stores = "ENCODED_MCT string, MCT_ME_D date"
    closing = spark.createDataFrame([("a", dt.date(2024, 3, 15)), ("b", None), ("c", None)], stores)
    open_ = spark.createDataFrame([(s, None) for s in "abc"], stores)
    scores = spark.createDataFrame([(s, m, 0.1 * i) for s in "abc" for i, m in enumerate(months(4))], "ENCODED_MCT string, TA_YM date, p_final double")
    for merchants, source, positives in ((closing, "closure", 3), (open_, "topq", 3)):
        out = label_cascade(base, base, merchants, scores)
        assert out.select("source").distinct().collect()[0].source == source
        assert out.count() == 12 and out.agg(F.sum("y")).first()[0] == positives
        assert "Join" not in plan_of(out) and "Window" not in plan_of(out)


def test_split_reads_its_labels_from_one_table(spark):
    left = spark.range(40).select(F.col("id").cast("string").alias("ENCODED_MCT"), F.lit(dt.date(2024, 1, 1)).alias("TA_YM"))
    labels = spark.range(40).select(F.col("id").cast("string").alias("ENCODED_MCT"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    out = stratified_split(left.join(labels, "ENCODED_MCT", "full"))
    assert "FullOuter" not in plan_of(out)
    assert {r.y: r.n for r in out.groupBy("y").agg(F.sum("is_test").alias("n")).collect()} == {0: 8, 1: 2}
