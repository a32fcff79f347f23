"""Inputs with broken keys and encodings, stream state across batches, one-hot, forest sampling."""
import datetime as dt

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from storewatch.constants import KEY_MCT, KEY_YM
from storewatch.operators import iforest
from storewatch.operators.models import ModelSizes, boosting_of, encoder_stages
from storewatch.operators.prepare import key_report, load_and_join, unique_keys
from storewatch.operators.ranking import global_quantiles, with_percent_ranks
from storewatch.session import new_folder
from storewatch.sources.files import detect_encoding, load_risk_output, write_csv
from storewatch.streaming.streams import (DELETE_MESSAGE, closing_row, read_stream_like, run_available_now,
                                          stream_dedup_requests, stream_persistence_alerts, stream_slot_sessions)

T0 = dt.datetime(2024, 1, 1)


def test_utf8_with_replacement_character_and_latin1(spark, tmp_path):
    rows = spark.createDataFrame([("10%이하", "ok"), ("broken � mark", "ok")], "a string, b string")
    write_csv(rows, str(tmp_path / "u"), "utf-8")
    assert detect_encoding(spark, str(tmp_path / "u")) == "utf-8"
    write_csv(rows.limit(1), str(tmp_path / "k"), "cp949")
    assert detect_encoding(spark, str(tmp_path / "k")) == "cp949"
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.csv").write_bytes(b"a,b\ncaf\xe9 \xff,1\n")
    assert detect_encoding(spark, str(tmp_path / "l")) == "latin1"


def test_missing_output_is_none_and_damaged_output_raises(spark, tmp_path):
    assert load_risk_output(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|read"):
        load_risk_output(spark, str(tmp_path / "bad")).count()


def test_duplicate_and_null_keys_never_multiply(spark):
    usage = spark.createDataFrame([("1", "202401", "10%이하"), ("1", "202401", "10%이하"), (None, "202401", "x")], f"{KEY_MCT} string, {KEY_YM} string, RC_M1_SAA string")
    cust = spark.createDataFrame([("1", "202401", 1.0), ("1", "202401", 2.0), ("2", "bad", 3.0)], f"{KEY_MCT} string, {KEY_YM} string, v double")
    merch = spark.createDataFrame([("1", "20240101"), ("1", "20250101")], f"{KEY_MCT} string, MCT_ME_D string")
    assert load_and_join(merch, usage, cust).count() == 1
    got = {r.input: tuple(r)[1:] for r in key_report({"u": usage, "c": cust, "m": merch}).collect()}
    assert got == {"u": (3, 1, 0, 1, 1), "c": (3, 0, 1, 1, 1), "m": (2, 0, 0, 1, 1)}
    assert unique_keys(cust).where(F.col(KEY_MCT) == "1").first().v == 1.0


def test_unseen_category_is_all_zeros(spark):
    train = spark.createDataFrame([("b",), ("b",), ("a",), ("c",)], "k string")
    model = Pipeline(stages=encoder_stages(["k"])).fit(train)
    out = model.transform(spark.createDataFrame([("b",), ("a",), ("c",), ("zz",), (None,)], "k string"))
    got = {r.k: list(r.v) for r in out.select("k", vector_to_array("k__oh").alias("v")).collect()}
    assert got == {"b": [1, 0, 0], "a": [0, 1, 0], "c": [0, 0, 1], "zz": [0, 0, 0], None: [0, 0, 0]}


def test_boosted_slots_differ():
    gb, xgb, lgbm = (boosting_of(x, ModelSizes()) for x in ("gb", "xgb", "lgbm"))
    assert (gb.rounds, gb.depth, xgb.rounds, xgb.depth, lgbm.rounds, lgbm.leaves, lgbm.depth) == (100, 3, 400, 5, 500, 31, None)
    assert xgb.row_share == 0.8 and lgbm.row_share == gb.row_share == 1.0 and xgb.column_share == lgbm.column_share == 0.8


@pytest.mark.parametrize("n", [40, 3000])
def test_forest_samples_without_replacement_at_every_size(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("k"), (F.rand(3) * 2).alias("x"), F.rand(4).alias("y"))
    df = df.unionByName(spark.createDataFrame([("far", 50.0, 50.0)], "k string, x double, y double"))
    forest = iforest.fit_forest(df, ["x", "y"], ["k"], n_trees=60, sample_size=64).cache()
    roots = [r["size"] for r in forest.where("node = 0").collect()]
    assert len(roots) == 60 and all(s == min(64, n + 1) for s in roots)
    scored = iforest.score_forest(df, forest, ["x", "y"])
    far = scored.where("k = 'far'").first().anomaly              # in few samples of a large table, but beyond every cut
    assert scored.where(F.col("anomaly") > far).count() <= 0.02 * n


def test_repeats_after_two_and_six_minutes_over_batches(spark):
    cols = ("store_id string, target_month string, region_code string, industry_code string, delivery_share double, sales_1m double, "
            "sales_3m_avg double, cust_1m double, cust_3m_avg double, ts timestamp")
    base = ("s", "2024-01", None, "", 0.5, 1.0, 1.0, 1.0, 1.0)
    rows = [(*base, T0 + dt.timedelta(minutes=m)) for m in (0, 2, 6)]
    rows += [("q", f"{m}", *base[2:], T0 + dt.timedelta(minutes=m)) for m in (5, 6.5)]     # other traffic
    rows += [(*base[:2], "", *base[3:], T0)]                      # null and '' are different payloads
    df = spark.createDataFrame(rows, cols)
    folder = new_folder(spark, "streams")
    src = read_stream_like(spark, df, f"{folder}/in", "ts", slices=13, files=1)
    out = run_available_now(stream_dedup_requests(src), folder, "dedup").where("store_id = 's'")
    got = sorted((str(r.region_code), (r.ts - T0).seconds // 60) for r in out.collect())
    assert got == [("", 0), ("None", 0), ("None", 6)]


def test_sessions_expire_delete_and_cross_batches(spark):
    none = (None,) * 6
    turns = [("a", 0, T0, "x", 100.0, *none), ("a", 1, T0 + dt.timedelta(hours=20), "y", 200.0, *none),
             ("a", 2, T0 + dt.timedelta(hours=60), "z", 300.0, *none),          # after the 24 h: a new session
             ("b", 0, T0, "x", 5.0, *none), ("b", 1, T0 + dt.timedelta(hours=1), DELETE_MESSAGE, None, *none),
             ("c", 0, T0, "x", 7.0, *none), ("c", 1, T0 + dt.timedelta(hours=2), "nothing", None, *none)]
    df = spark.createDataFrame(turns, "session_id string, turn int, ts timestamp, message string, sales_1m double, sales_3m_avg double, "
                                      "cust_1m double, cust_3m_avg double, industry_code string, region_code string, delivery_share double")
    folder = new_folder(spark, "streams")
    src = read_stream_like(spark, df, f"{folder}/in", "ts", closing=closing_row(df, "ts", "3 DAYS", turn=0, message=""))
    out = run_available_now(stream_slot_sessions(src), folder, "sessions").collect()
    assert sorted((r.session_id, r.turn, r.sales_1m) for r in out) == [("a", 1, 200.0), ("a", 2, 300.0), ("b", 1, None), ("c", 1, 7.0)]


def test_persistence_state_crosses_batches_and_skips_missing_scores(spark):
    p = [0.45, 0.1, None, 0.45, 0.5, 0.6]
    df = spark.createDataFrame([("s", T0 + dt.timedelta(days=i), v) for i, v in enumerate(p)], "store_id string, ts timestamp, p_final double")
    folder = new_folder(spark, "streams")
    out = run_available_now(stream_persistence_alerts(read_stream_like(spark, df, f"{folder}/in", "ts", slices=3, files=1)), folder, "p")
    got = [(round(r.pbar, 6), r.alert) for r in out.orderBy("ts").collect()]
    assert got == [(0.45, "RED"), (0.275, "GREEN"), (round(1 / 3, 6), "ORANGE"), (0.35, "RED"), (round(1.55 / 3, 6), "RED")]


def test_one_subquery_for_several_quantiles_and_null_groups(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"), F.when(F.col("id") < 90, F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    a, b = global_quantiles(df, "v", [0.25, 0.75])
    q = df.select((F.col("v") > a).alias("x"), (F.col("v") > b).alias("y"))
    assert q._jdf.queryExecution().optimizedPlan().toString().count("scalar-subquery") <= 2
    assert (q.where("x").count(), q.where("y").count()) == (75, 25)
    ranked = with_percent_ranks(df, ["k"], [("r", ["g"], "v", False)])
    assert ranked.where("g is null and r is not null").count() == 0
