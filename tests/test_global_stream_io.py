"""Global-boundary windows vs pandas, streaming session state vs batch slot filling, isolation forest
sanity, CSV encoding detection."""
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from storewatch.operators.windows import with_global_chunks, with_robust_z


def test_global_boundary_matches_unpartitioned_pandas(spark):
    rng = np.random.default_rng(5)
    rows = [(f"S{s:02d}", pd.Timestamp(2020, 1, 1) + pd.DateOffset(months=m), float(rng.normal()))
            for s in range(12) for m in range(15)]
    pdf = pd.DataFrame(rows, columns=["ENCODED_MCT", "TA_YM", "x"])
    pdf.loc[rng.choice(len(pdf), 15, replace=False), "x"] = np.nan
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None)).withColumn("TA_YM", F.to_date("TA_YM"))
    chunked, w = with_global_chunks(sdf, ["ENCODED_MCT", "TA_YM"], num_chunks=4)
    out = with_robust_z(chunked, {"r": F.col("x")}, w).where(~F.col("_halo")).toPandas()
    out = out.sort_values(["ENCODED_MCT", "TA_YM"]).reset_index(drop=True)
    x = pdf.sort_values(["ENCODED_MCT", "TA_YM"]).x.reset_index(drop=True)
    med = x.rolling(12, min_periods=6).median()
    mad = 1.4826 * (x - med).abs().rolling(12, min_periods=6).median()
    np.testing.assert_allclose(out.r_med.astype(float), med, rtol=1e-9, equal_nan=True)
    np.testing.assert_allclose(out.r_z.astype(float), (x - med) / (mad + 1e-6), rtol=1e-9, equal_nan=True)
    plan = with_robust_z(chunked, {"r": F.col("x")}, w)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_stream_sessions_equal_batch_slots(spark):
    from storewatch.operators.dialogue import SLOTS, fill_slots, parse_messages
    from storewatch.streaming.streams import closing_row, read_stream_like, run_available_now, stream_slot_sessions
    turns = [("a", 0, "치킨집 강남구에서 지난달 매출 1500만원"), ("a", 1, "최근 3개월 평균 매출 1800만원"),
             ("b", 0, "카페 하는데 한 달 매출 900만원"), ("b", 1, "__delete__"), ("b", 2, "피자 가게 마포구")]
    df = spark.createDataFrame(turns, "session_id string, turn int, message string").withColumn(
        "ts", F.to_timestamp(F.lit("2024-01-01 10:00:00")) + F.make_interval(mins=F.col("turn")))
    parsed = parse_messages(df)
    base = tempfile.mkdtemp(prefix="sw-stream-")
    src = read_stream_like(spark, parsed, f"{base}/in", "ts", closing=closing_row(parsed, "ts", "3 DAYS", turn=0, message=""))
    got = {r.session_id: r for r in run_available_now(stream_slot_sessions(src), base, "s").collect()}
    last = fill_slots(parsed.where("session_id = 'a'")).orderBy(F.desc("turn")).first()   # final state = last batch turn
    assert set(got) == {"a", "b"} and got["a"].turn == last.turn
    for s in SLOTS:
        assert got["a"][s] == last[s], s
    assert got["b"].industry_code == "피자" and got["b"].sales_1m is None   # cleared by delete


def test_isolation_forest_flags_outliers(spark):
    from storewatch.operators.iforest import fit_forest, score_forest
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(500, 2))
    pts[:5] += 8.0
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, a double, b double")
    forest = fit_forest(df, ["a", "b"], ["id"], n_trees=50, sample_size=64)
    s = score_forest(df, forest, ["a", "b"]).toPandas().set_index("id").anomaly
    assert s.loc[:4].min() > s.loc[5:].quantile(0.95)
    assert ((s > 0) & (s <= 1)).all()


def test_csv_encoding_detection(spark):
    from storewatch.sources.files import read_csv_smart
    base = tempfile.mkdtemp(prefix="sw-csv-")
    text = "ENCODED_MCT,RC_M1_SAA\nA1,10%이하\nB2,90%초과\n"
    found = {}
    for enc in ("utf-8", "cp949", "euc-kr"):
        os.makedirs(f"{base}/{enc}")
        with open(f"{base}/{enc}/part.csv", "wb") as fh:
            fh.write(text.encode(enc))
        df, found[enc] = read_csv_smart(spark, f"{base}/{enc}")
        assert sorted(r.RC_M1_SAA for r in df.collect()) == ["10%이하", "90%초과"]
    assert found == {"utf-8": "utf-8", "cp949": "cp949", "euc-kr": "cp949"}
