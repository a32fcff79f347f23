"""Ensemble column resolution, Platt closed forms, split sizes, ranking metrics vs brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from storewatch.operators.ensemble import fit_logistic, platt_lstsq_params, weighted_ensemble
from storewatch.operators.labels import stratified_split
from storewatch.operators.metrics import average_precision, roc_auc


def test_ensemble_aliases_and_missing(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5, 0.5), (0.2, None, 0.2, 0.2, 0.2)],
                               "pred_xgb double, pred_lgbm double, pred_rf double, pred_gbdt double, pred_nn double")
    r = df.select(weighted_ensemble(df).alias("p")).collect()
    assert r[0].p == pytest.approx(0.5) and r[1].p is None
    part = df.drop("pred_rf", "pred_nn")
    r2 = part.select(weighted_ensemble(part).alias("p"), weighted_ensemble(part, renormalize=True).alias("q")).first()
    assert r2.p == pytest.approx(0.5 * 0.65) and r2.q == pytest.approx(0.5)


def test_platt_lstsq_matches_numpy(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0.01, 0.99, 200)
    y = (rng.random(200) < p).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)], "p double, y double")
    ab = platt_lstsq_params(df, "p", "y").first()
    X = np.column_stack([np.ones_like(p), np.log(p / (1 - p))])
    b, a = np.linalg.lstsq(X, y, rcond=None)[0]
    assert ab.a == pytest.approx(a, rel=1e-9) and ab.b == pytest.approx(b, rel=1e-9)


def test_platt_constant_score_min_norm(spark):
    df = spark.createDataFrame([(0.3, 1.0), (0.3, 0.0), (0.3, 1.0)], "p double, y double")
    ab = platt_lstsq_params(df, "p", "y").first()
    X = np.column_stack([np.ones(3), np.full(3, np.log(0.3 / 0.7))])
    b, a = np.linalg.lstsq(X, np.array([1.0, 0.0, 1.0]), rcond=None)[0]
    assert ab.a == pytest.approx(a, rel=1e-9) and ab.b == pytest.approx(b, rel=1e-9)


def _labeled(spark, n_neg, n_pos):
    rows = [(f"s{i}", "2023-01-01", 0) for i in range(n_neg)] + [(f"p{i}", "2023-01-01", 1) for i in range(n_pos)]
    return spark.createDataFrame(rows, "ENCODED_MCT string, TA_YM string, y int").withColumn("TA_YM", F.to_date("TA_YM"))


def test_split_sizes(spark):
    out = stratified_split(_labeled(spark, 40, 10)).groupBy("y").agg(F.sum("is_test").alias("t")).collect()
    assert {r.y: r.t for r in out} == {0: 10, 1: 2}            # round-half-even of 2.5
    one = stratified_split(_labeled(spark, 40, 1))
    assert one.where("is_test = 1 AND is_train = 1").count() == 41


def _auc_brute(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def _ap_brute(s, y):
    order = np.argsort(-s, kind="stable")
    ap, tp = 0.0, 0
    for t in np.unique(s)[::-1]:
        sel = s >= t
        tp = y[sel].sum()
        ap += (y[s == t].sum() / y.sum()) * tp / sel.sum()
    return ap


def test_auc_ap_brute_force(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(400), 1)
    y = (rng.random(400) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    assert roc_auc(df, "s", "y").first().roc_auc == pytest.approx(_auc_brute(s, y), rel=1e-12)
    assert average_precision(df, "s", "y").first().avg_precision == pytest.approx(_ap_brute(s, y), rel=1e-12)
    one = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    r = roc_auc(one, "s", "y").first()
    assert r.roc_auc is None and r.note == "single-class"


def _newton_by_hand(s, y):
    a, b = 0.0, np.log(y.mean() / (1 - y.mean()))
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a * s + b)))
        w = p * (1 - p)
        step = np.linalg.solve([[(w * s * s).sum() + 1, (w * s).sum()], [(w * s).sum(), w.sum()]], [((p - y) * s).sum() + a, (p - y).sum()])
        a, b = a - step[0], b - step[1]
    return a, b


def test_logistic_calibration_and_its_rules(spark):
    rng = np.random.default_rng(5)
    s = rng.uniform(0, 1, 300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(6 * s - 4)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, y)], "s double, y double")
    fitted = fit_logistic(df, "s", "y")
    assert (fitted.a, fitted.b) == pytest.approx(_newton_by_hand(s, y), rel=1e-8)
    odd = [float("nan"), None, float("inf"), float("-inf")]
    rows = [(odd[i % 4] if i % 5 == 0 else float(a), float(b)) for i, (a, b) in enumerate(zip(s, y))] + [(0.5, None)]
    fitted = fit_logistic(spark.createDataFrame(rows, "s double, y double"), "s", "y")
    kept = np.array([a for i, a in enumerate(s) if i % 5])
    assert fitted.fill == pytest.approx(np.median(kept))
    filled = np.array([np.median(kept) if i % 5 == 0 else a for i, a in enumerate(s)])
    assert (fitted.a, fitted.b) == pytest.approx(_newton_by_hand(filled, y), rel=1e-8)
    same = fit_logistic(df.withColumn("s", F.lit(0.3)), "s", "y")
    one = fit_logistic(df.withColumn("y", F.lit(1.0)), "s", "y")
    assert same.a is None and "constant" in same.note and one.a is None and "single" in one.note
    assert df.select(one.transform("s").alias("p")).first().p == pytest.approx(s[0])
    none = fit_logistic(spark.createDataFrame([(None, 1.0), (None, 0.0)], "s double, y double"), "s", "y")
    assert none.fill == 0.5 and none.note
    steep = spark.createDataFrame([(i / 100, float(i > 50)) for i in range(100)] + [(1000.0, 1.0)], "s double, y double")
    steep_fit = fit_logistic(steep, "s", "y")
    assert np.isfinite(steep_fit.a) and steep_fit.a > 0
