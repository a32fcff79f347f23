"""Plan-shape regression checks: no cross products anywhere in the key queries, and windows never run
on a single partition (global aggregates may end in one partition: one partial row per task)."""
import re

import pytest

import __spark_entry__ as E
from data_paths import SF_SMALL

KEY_QUERIES = ["risk_pipeline_model", "quantile_alert", "quantile_alert_fallback", "benchmark", "topq_label",
               "peer_percentile", "roc_auc", "stratified_split", "all_risks_global", "history", "latest_risk"]


@pytest.mark.parametrize("name", KEY_QUERIES)
def test_no_cross_products_or_single_partition_windows(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            assert "], []" not in line, line          # a window with an empty partition spec


def test_history_has_partial_group_limit(spark):
    plan = E.queries()["history"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
