"""Scalar functions on hand fixtures: null-safe clips, bins, months."""
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storewatch.functions.bins import bin_rank, with_bin_rank_lenient
from storewatch.functions.core import clip01, logistic, nanmax, relu_minus, safe_null, to_percent, zero01
from storewatch.functions.months import horizon_end, month_lenient


def _rows(spark, values, typ=T.DoubleType()):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)],
                                 T.StructType([T.StructField("i", T.IntegerType()), T.StructField("x", typ)]))


def test_null_clip_family(spark):
    df = _rows(spark, [None, float("nan"), -1.0, 0.0, 0.5, 1.0, 2.0])
    df = df.withColumn("x", safe_null("x"))      # NaN -> NULL at ingest
    out = {r.i: r for r in df.select("i", clip01("x").alias("nz"), zero01("x").alias("z"),
                                     relu_minus("x").alias("rm"), to_percent(F.col("x") * 100).alias("tp"),
                                     nanmax("x", F.lit(0.25)).alias("mx")).collect()}
    assert out[0].nz is None and out[1].nz is None and out[0].z == 0.0 and out[1].z == 0.0
    assert [out[i].nz for i in range(2, 7)] == [0.0, 0.0, 0.5, 1.0, 1.0]
    assert [out[i].rm for i in range(2, 7)] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert out[0].rm is None and out[0].mx is None and out[4].mx == 0.5 and out[3].mx == 0.25
    assert out[6].tp == 1.0 and out[2].tp == 0.0


def test_logistic_extremes(spark):
    r = _rows(spark, [-1e6, 0.0, 1e6]).select(logistic(F.col("x")).alias("p")).collect()
    assert r[0].p == pytest.approx(0.0, abs=1e-300) and r[1].p == 0.5 and r[2].p == 1.0


def test_sentinel_to_missing(spark):
    r = _rows(spark, ["-999999", "-900000", "12.5", "abc", None], T.StringType()).select(safe_null("x").alias("v")).collect()
    assert [x.v for x in r] == [None, None, 12.5, None, None]


BINS = ["10%이하", "10 ~ 25%", "30-40%", "95%초과", "7%이하", "10%미만", "0.3", "nan", None]


def test_bin_rank_strict(spark):
    r = _rows(spark, BINS, T.StringType()).select(bin_rank("x").alias("r")).collect()
    assert [x.r for x in r] == [0.05, 0.175, None, None, None, None, 0.3, None, None]


def test_bin_rank_lenient(spark):
    df = with_bin_rank_lenient(_rows(spark, BINS, T.StringType()), {"r": "x"})
    got = [x.r for x in df.orderBy("i").collect()]
    assert got[0] == 0.05 and got[1] == 0.175 and got[2] == pytest.approx(0.35)
    assert got[3] == 0.95                      # min(.95, max(.90, .95 + .05))
    assert got[4] == 0.05                      # max(.05, min(.10, .07 - .05))
    assert got[5] == 0.05                      # 미만 -> 이하, then the table
    assert got[6] == 0.3 and got[7] is None and got[8] is None


def test_months(spark):
    df = _rows(spark, ["202301", "2023-01", "2023-01-15", "bad", None], T.StringType())
    got = [r.m for r in df.orderBy("i").select(month_lenient("x").alias("m")).collect()]
    assert [str(g) if g else None for g in got] == ["2023-01-01", "2023-01-01", "2023-01-01", None, None]
    end = spark.range(1).select(horizon_end(F.to_date(F.lit("2023-02-01")), 3).alias("e")).first().e
    assert str(end) == "2023-05-28"
