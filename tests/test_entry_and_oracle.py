"""Driver contract on sf0.001 and a DuckDB cross-check of a few queries."""
import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from data_paths import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "labels", "conversations"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["ENCODED_MCT", "TA_YM", "Sales_Risk", "Customer_Risk", "Market_Risk", "RiskScore",
                          "p_model", "p_final", "Alert"]
    for r in rows:
        for c in ("Sales_Risk", "Customer_Risk", "Market_Risk"):
            assert 0.0 <= r[c] <= 1.0
        assert abs(r.RiskScore - (0.4 * r.Sales_Risk + 0.3 * r.Customer_Risk + 0.3 * r.Market_Risk)) < 2e-6


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
        df[c] = df[c].astype(str).replace({"None": "nan", "NaT": "nan", "<NA>": "nan"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", ["risk_pipeline_model", "quantile_alert", "roc_auc", "stratified_split",
                                  "parse_utterance", "latest_risk", "hhi", "trend_forecast"])
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    a = _norm(E.queries()[name](spark, SF_SMALL).toPandas())
    b = _norm(con.execute(E.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    assert (a.values == b.values).all()
