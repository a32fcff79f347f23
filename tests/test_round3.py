"""Shared steps at size: aggregates of lines are hashed, shuffles are sized by rows, no month in one task."""
import contextlib
import io

from pyspark.sql import Row
from pyspark.sql import functions as F

from data_paths import SF_SMALL
from storewatch.operators.ranking import with_percent_ranks
from storewatch.session import spread
from storewatch.sources.panel import _SEGMENTS, _segment_code, line_grain, store_month
from storewatch.sources.tables import Tables


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_lines_are_hashed_not_sorted(spark):
    t = Tables(spark, SF_SMALL)
    for df in (line_grain(t), store_month(t)):
        assert "SortAggregate" not in _plan(df)


def test_segment_codes_keep_the_order_of_the_names(spark):
    names = ["", "AAA", "AUTOMOBILE", "BUILDINGS", "BUILDING", "HOUSE", "HOUSEHOLD", "MACHINERY", "ZZZ", "building"]
    got = {r.s: r.c for r in spark.createDataFrame([(n,) for n in names] + [(None,)], "s string").select("s", _segment_code(F.col("s")).alias("c")).collect()}
    assert got.pop(None) is None
    for a in names:
        assert (got[a] % 2 == 1) == (a in _SEGMENTS)
        for b in names:
            if a < b:
                assert got[a] <= got[b] and (got[a] < got[b] or a not in _SEGMENTS)


def test_shuffles_grow_with_the_rows(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 97)
    assert spread(df, 1000, "k", per=1000) is df
    wide = spread(df, 1000, "k", per=20)
    assert wide.rdd.getNumPartitions() == 50
    assert wide.groupBy(F.spark_partition_id().alias("p"), "k").count().count() == 97


def test_group_names_of_percent_ranks_never_meet(spark):
    rows = spark.createDataFrame([(1, "a", "1:b", 1.0), (2, "a1:", "b", 2.0), (3, "a", "1:b", 3.0), (4, None, "b", 9.0), (5, "a", "1:b", None)],
                                 "k int, x string, y string, v double")
    out = {r.k: (r.p, r.d) for r in with_percent_ranks(rows, ["k"], [("p", ["x", "y"], "v", False), ("d", [], "v", True)]).collect()}
    assert out == {1: (0.0, 1.0), 2: (0.0, 2 / 3), 3: (1.0, 1 / 3), 4: (None, 0.0), 5: (None, None)}
    assert "to_json" not in _plan(with_percent_ranks(rows, ["k"], [("p", ["x", "y"], "v", False)]))


def test_high_risk_places_without_a_window_of_a_whole_month(spark):
    from storewatch.operators.trends import high_risk_stores
    rows = [("m", "b", 0.5), ("m", "a", 0.5), ("m", "c", 0.9), ("m", "c", 0.9), ("m", "d", 0.1), ("n", "a", None), (None, "z", 0.4), ("n", None, 0.7),
            ("n", "e", float("nan"))]
    df = spark.createDataFrame(rows, "target_month string, store_id string, p_final double")
    high = high_risk_stores(df)
    assert "[target_month#" not in "".join(line for line in _plan(high).splitlines() if "Window" in line)
    got = sorted(map(repr, (tuple(r) for r in high.collect())))
    assert got == sorted(map(repr, [("m", "c", 0.9, 1), ("m", "c", 0.9, 2), ("m", "a", 0.5, 3), ("m", "b", 0.5, 4), (None, "z", 0.4, 1),
                                    ("n", None, 0.7, 2), ("n", "e", float("nan"), 1)]))


def test_every_factor_term_is_written_once(spark):
    from storewatch.constants import BIN_COLS, KEY_MCT, KEY_YM
    from storewatch.operators.factors import risk_factors
    from storewatch.operators.risk import INPUT_COLS
    row = Row(**{KEY_MCT: "1", KEY_YM: None} | {f"{c}_RANK": 0.5 for c in BIN_COLS} | {c: 50.0 for c in INPUT_COLS})
    types = f"{KEY_MCT} string, {KEY_YM} date, " + ", ".join(f"{c} double" for c in [*[f"{c}_RANK" for c in BIN_COLS], *INPUT_COLS])
    plan = risk_factors(spark.createDataFrame([tuple(row)], types))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("struct(less,") == 1 and "array_sort(" not in plan
