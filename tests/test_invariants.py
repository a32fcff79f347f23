"""Invariants of the batch scoring on sf0.001: component ranges, golden arithmetic of the
top rows without a model (RiskScore = .4S + .3C + .3M, p_final = .4 RiskScore), alerts monotone in the
score within a month, quick score never above .265."""
import pandas as pd

import __spark_entry__ as E
from data_paths import SF_SMALL


def test_pipeline_invariants(spark):
    out = E.queries()["risk_pipeline"](spark, SF_SMALL).toPandas()
    for c in ("Sales_Risk", "Customer_Risk", "Market_Risk", "RiskScore", "p_final"):
        assert out[c].between(0, 1).all()
    assert ((out.RiskScore - (0.4 * out.Sales_Risk + 0.3 * out.Customer_Risk + 0.3 * out.Market_Risk)).abs() < 2e-6).all()
    assert ((out.p_final - 0.4 * out.RiskScore).abs() < 2e-6).all() and (out.p_model == 0).all()
    level = {"GREEN": 0, "YELLOW": 1, "ORANGE": 2, "RED": 3}
    for _, g in out.groupby("TA_YM"):
        g = g.sort_values("p_final")
        lv = g.Alert.map(level).to_numpy()
        assert (lv[1:] >= lv[:-1]).all()


def test_topk_is_sorted_and_bounded(spark):
    top = E.queries()["topk_risk"](spark, SF_SMALL).toPandas()
    assert len(top) == 20 and top.p_final.is_monotonic_decreasing


def test_quickscore_ceiling(spark):
    q = E.queries()["quickscore"](spark, SF_SMALL).toPandas()
    assert (q.p_final <= 0.265 + 1e-9).all() and set(q.alert) == {"GREEN"}
