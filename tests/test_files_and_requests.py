"""Typed CSV inputs, sinks, look-ups with repeated arguments, request rules, factors and report content."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from storewatch.constants import KEY_MCT, KEY_YM
from storewatch.operators.factors import TERMS, risk_factors
from storewatch.operators.lookup import apply_thresholds, store_timeline
from storewatch.operators.prepare import load_and_join, normalize_bins
from storewatch.operators.trends import high_risk_stores, period_report_json
from storewatch.operators.validate import validate_configs, validate_feedback, validate_history_requests
from storewatch.plans.catalog import panel
from storewatch.session import new_folder
from storewatch.sources.files import read_predictions, replace_folder, replace_months, write_predictions, write_top
from storewatch.sources.typed import MERCHANTS, PREDS, read_typed_csv
from data_paths import SF_SMALL


def write_lines(spark, lines, encoding=None):
    path = new_folder(spark, "csv")
    writer = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write
    writer.option("encoding", encoding or "utf-8").csv(path, quote="", sep="\x01", escapeQuotes=False, emptyValue="")
    return path


def test_typed_csv_sets_broken_lines_aside(spark):
    path = write_lines(spark, ["TA_YM,ENCODED_MCT,pred_rf,other,pred_xgb", "2024-01-01,1,0.5,x,0.25", "2024-01-01,2,abc,x,0.25", "2024-01-01,3,0.5",
                               "2024-01-01,4,0.5,x,0.25,more", ",5,0.5,x,0.25", '2024-01-01,,0.5,"a, b",', "2024-02-01,6,,,"])
    t = read_typed_csv(spark, path, PREDS, [KEY_MCT, KEY_YM])
    assert [(r[KEY_MCT], r.pred_rf, r.pred_xgb, r.pred_dl) for r in t.valid.orderBy(KEY_MCT).collect()] == [("1", 0.5, 0.25, None), ("6", None, None, None)]
    assert t.valid.schema.fieldNames() == PREDS.fieldNames()
    bad = sorted((tuple(r.reasons), r.line) for r in t.quarantine.collect())
    assert [b[0] for b in bad] == [("malformed",)] * 3 + [("missing ENCODED_MCT",), ("missing TA_YM",)]
    assert {b[1] for b in bad[:3]} == {"2024-01-01,2,abc,x,0.25", "2024-01-01,3,0.5", "2024-01-01,4,0.5,x,0.25,more"}
    nothing = read_typed_csv(spark, write_lines(spark, ["TA_YM,pred_rf", "2024-01-01,1"]), PREDS, [KEY_MCT])
    assert nothing.valid.count() == 0 and nothing.quarantine.first().reasons == ["missing ENCODED_MCT"]
    korean = read_typed_csv(spark, write_lines(spark, ["ENCODED_MCT,HPSN_MCT_ZCD_NM,MCT_ME_D", "1,편의점 음식점,2024-05-01"], "cp949"), MERCHANTS, [KEY_MCT])
    row = korean.valid.first()
    assert (row.HPSN_MCT_ZCD_NM, row.MCT_ME_D, row.HPSN_MCT_BZN_CD_NM) == ("편의점 음식점", dt.date(2024, 5, 1), None)


def preds(spark, rows):
    return spark.createDataFrame([(s, dt.date(2024, m, 1) if m else None, v, v, v, v, v) for s, m, v in rows],
                                 f"{KEY_MCT} string, {KEY_YM} date, pred_xgb double, pred_lgbm double, pred_rf double, pred_gb double, pred_dl double")


def test_a_rerun_of_a_month_replaces_that_month(spark):
    path = new_folder(spark, "preds")
    write_predictions(preds(spark, [("a", 1, 0.1), ("b", 1, 0.2), ("a", 2, 0.3), (None, 2, 0.9), ("c", None, 0.9)]), path)
    write_predictions(preds(spark, [("a", 1, 0.7)]), path)
    got = sorted((r[KEY_MCT], r[KEY_YM].month, r.pred_dl) for r in read_predictions(spark, path).collect())
    assert got == [("a", 1, 0.7), ("a", 2, 0.3)]
    replace_months(preds(spark, []), path)
    assert read_predictions(spark, path).count() == 2


def test_a_failed_run_leaves_the_old_content(spark):
    path = new_folder(spark, "out")
    replace_folder(spark.range(3), path)
    with pytest.raises(Exception):
        replace_folder(spark.range(5).select(F.raise_error(F.lit("stop")).alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    replace_folder(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7
    top = new_folder(spark, "top")
    write_top(spark.range(9).orderBy(F.desc("id")), top)
    write_top(spark.range(4).orderBy(F.desc("id")), top)
    back = spark.read.option("header", True).csv(top)
    assert [r.id for r in back.collect()] == ["3", "2", "1", "0"] and len(back.inputFiles()) == 1


def test_repeated_arguments_do_not_repeat_rows(spark):
    scores = spark.createDataFrame([("a", dt.date(2024, m, 1), 0.32) for m in range(1, 7)] + [("b", dt.date(2024, 1, 1), 0.32)], f"{KEY_MCT} string, {KEY_YM} date, p_final double")
    config = spark.createDataFrame([("a", 0.1, 0.2, 0.3, True, ["sms"], 1), ("a", 0.5, 0.6, 0.7, True, ["email"], 2), ("a", 0.5, 0.6, 0.7, True, ["email"], 2),
                                    ("b", 0.1, 0.2, 0.3, True, ["sms"], 1), ("b", 0.1, 0.2, 0.3, False, ["sms"], 3)],
                                   f"{KEY_MCT} string, yellow double, orange double, red double, enabled boolean, channels array<string>, updated_at int")
    got = apply_thresholds(scores, config).collect()
    assert len(got) == 7 and {r.alert for r in got if r[KEY_MCT] == "a"} == {"GREEN"} and [r.alert for r in got if r[KEY_MCT] == "b"] == ["ORANGE"]
    assert {r.alert for r in apply_thresholds(scores, config.drop("updated_at").where("red < 0.5 and enabled")).collect()} == {"RED"}
    periods = spark.createDataFrame([("a", dt.date(2024, 1, 1), dt.date(2024, 2, 1)), ("a", dt.date(2024, 2, 1), None), ("a", None, dt.date(2024, 1, 1))],
                                    f"{KEY_MCT} string, start date, end date")
    assert [r[KEY_YM].month for r in store_timeline(scores, periods=periods).collect()] == [1, 2, 3, 4, 5, 6]


def test_request_rules(spark):
    f = spark.createDataFrame([("1", "s", 1), ("2", "s", 5), ("3", "s", 0), ("4", "s", 6), ("5", None, None), (None, "s", 3)], "id string, session_id string, rating int")
    assert [r.reasons for r in validate_feedback(f).collect()] == [[], [], ["rating"], ["rating"], ["session_id", "rating"], ["id"]]
    c = spark.createDataFrame([("1", None, 0.0, 1.0, None), ("2", -0.01, 0.3, 1.01, ["email", None]), (None, 0.1, 0.2, 0.3, ["fax"])],
                              "store_id string, yellow double, orange double, red double, channels array<string>")
    assert [r.reasons for r in validate_configs(c).collect()] == [[], ["yellow", "red", "channels"], ["store_id", "channels"]]
    h = spark.createDataFrame([(None, None, 1), ("2024-01", "2024-01", 1000), ("2024-02", "2024-01", 0), ("24-01", None, None)], "start string, end string, limit int")
    assert [r.reasons for r in validate_history_requests(h).collect()] == [[], [], ["limit", "period"], ["start", "limit"]]


def test_factors_add_up_and_report_content_is_json(spark):
    assert len(TERMS) == 13 and {sum(w for c, _, w, _, _ in TERMS if c == k) for k in {t[0] for t in TERMS}} == {1.0}
    p = panel(spark, SF_SMALL)
    rows = risk_factors(normalize_bins(load_and_join(p.merchants, p.usage, p.customers))).collect()
    for r in rows:
        assert len(r.factors) == 13 and abs(sum(f.contribution for f in r.factors) - r.RiskScore) < 1e-9
        assert all(a.contribution >= b.contribution - 1e-9 for a, b in zip(r.factors, r.factors[1:])) and len(r.insights) <= 3
        for c, weight in (("Sales_Risk", 0.4), ("Customer_Risk", 0.3), ("Market_Risk", 0.3)):
            assert abs(sum(f.contribution for f in r.factors if f.component == c) - weight * r[c]) < 1e-9
    risk = spark.createDataFrame([("a", dt.date(2024, m, 1), 0.1 * m, 0.2, "RED" if m == 3 else "GREEN") for m in (3, 1, 2)],
                                 f"{KEY_MCT} string, {KEY_YM} date, p_final double, RiskScore double, Alert string")
    content = json.loads(period_report_json(risk, "2024-01", "2024-12").first().content)
    assert [m["month"] for m in content["months"]] == ["2024-01", "2024-02", "2024-03"] and content["summary"]["n_red"] == 1
    assert content["summary"]["mean_p_final"] == 0.2 and content["months"][2]["alert"] == "RED"
    high = high_risk_stores(spark.createDataFrame([("m", "b", 0.5), ("m", "a", 0.5), ("m", "c", 0.9), ("m", "d", 0.1), ("n", "a", None)],
                                                  "target_month string, store_id string, p_final double"), 0.5)
    assert [(r.store_id, r.place) for r in high.orderBy("place").collect()] == [("c", 1), ("a", 2), ("b", 3)]
