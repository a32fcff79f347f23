"""Distributed ranks, quantiles and running sums against brute force (ties, a hot group, NULLs)."""
import numpy as np
import pandas as pd
import pytest

from storewatch.operators.ranking import group_quantiles, value_ranks, with_percent_rank


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 3000
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))   # one group holds most rows
    v = np.round(rng.normal(size=n), 1)                                          # many ties
    v[rng.random(n) < 0.02] = np.nan
    w = rng.integers(0, 2, n)
    pdf = pd.DataFrame({"g": g, "v": v, "w": w})
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))
    return pdf, sdf


def test_quantiles_match_pandas(data):
    pdf, sdf = data
    q = group_quantiles(sdf, ["g"], "v", [0.8, 0.9, 0.97, 0.5], names=["q8", "q9", "q97", "q5"]).toPandas()
    for _, row in q.iterrows():
        s = pdf.loc[pdf.g == row.g, "v"].dropna()
        for name, p in (("q8", .8), ("q9", .9), ("q97", .97), ("q5", .5)):
            assert row[name] == pytest.approx(s.quantile(p), rel=1e-12, abs=1e-12)


def test_global_quantile_and_running_sums(data):
    pdf, sdf = data
    q = group_quantiles(sdf, [], "v", [0.25]).first()[0]
    assert q == pytest.approx(pdf.v.dropna().quantile(0.25))
    vr = value_ranks(sdf, ["g"], "v", ["w"]).toPandas().sort_values(["g", "v"])
    for g, part in vr.groupby("g"):
        s = pdf[(pdf.g == g) & pdf.v.notna()]
        counts = s.groupby("v").size().sort_index()
        assert list(part["n"]) == list(counts.values)
        assert list(part["lt"]) == list(np.concatenate([[0], np.cumsum(counts.values)[:-1]]))
        assert list(part["cum_w"]) == list(s.groupby("v").w.sum().sort_index().cumsum().values)


def test_percent_rank(data, spark):
    pdf, sdf = data
    pr = with_percent_rank(sdf, ["g"], "v", "pr").toPandas()
    ref = pdf.copy()
    ref["pr"] = ref.groupby("g").v.rank(method="min")
    ref["n"] = ref.groupby("g").v.transform("count")
    ref["pr"] = ((ref.pr - 1) / (ref.n - 1)).where(ref.v.notna())
    a = np.sort(pr.pr.dropna().values)
    b = np.sort(ref.pr.dropna().values)
    assert len(a) == len(b) and np.allclose(a, b)
