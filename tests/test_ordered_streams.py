"""Streams that are rated in order of event time, the feedback table and the session table."""
import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from storewatch.session import new_folder
from storewatch.streaming import ordered
from storewatch.streaming.streams import closing_row, read_stream_like, run_available_now
from storewatch.streaming.tables import FEEDBACK, SESSION, FeedbackTable, SessionTable, run_into

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    ordered.use_rocksdb(spark)


def shuffled(spark, df, time, days, seed):
    """The rows landed in an order that is off by up to ``days`` days, in several micro-batches."""
    jitter = F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(days * 86_400)).cast("int")
    late = df.withColumn("_arrival", F.timestamp_micros(F.unix_micros(time) + jitter.cast("long") * 1_000_000))
    end = closing_row(late, "_arrival", "400 DAYS").withColumn(time, F.col("_arrival"))
    folder = new_folder(spark, "streams")
    return read_stream_like(spark, late, f"{folder}/in", "_arrival", slices=4, files=2, closing=end), folder


def test_alerts_do_not_depend_on_arrival(spark):
    rng = random.Random(4)
    rows = [(s, T0 + dt.timedelta(days=i), None if i % 11 == 5 else rng.random()) for s in ("a", "b", "c") for i in range(60)]
    rows += [(None, T0, 0.5)]
    df = spark.createDataFrame(rows, "store_id string, ts timestamp, p_final double")
    src, folder = shuffled(spark, df, "ts", 20, 1)
    out = run_available_now(ordered.ordered_alerts(src, "25 days"), folder, "alerts").collect()
    want = {}
    for s, of in pd.DataFrame(rows[:-1], columns=["s", "ts", "p"]).dropna().sort_values("ts").groupby("s"):
        want |= {(s, t): round(m, 9) for t, m in zip(of.ts, of.p.rolling(3, min_periods=1).mean())}
    assert {(r.store_id, r.ts): round(r.pbar, 9) for r in out} == want and len(out) == len(want)


def test_repeats_get_the_first_result(spark):
    def row(store, seconds, score):
        return (store, "2024-02", None, "카페", 0.5, 1.0, 2.0, 3.0, 4.0, T0 + dt.timedelta(seconds=seconds), f"{store}-{seconds}",
                0.1, 0.2, 0.3, score, score, "GREEN")

    schema = ("store_id string, target_month string, region_code string, industry_code string, delivery_share double, sales_1m double, "
              "sales_3m_avg double, cust_1m double, cust_3m_avg double, ts timestamp, id string, Sales_Risk double, Customer_Risk double, "
              "Market_Risk double, risk_score double, p_final double, alert string")
    rows = [row("a", t, t / 1000) for t in (0, 100, 299, 300, 301, 500, 599, 600, 2000)] + [row("b", t, 0.5) for t in (10, 40)]
    rows.append((*row("a", 50, 0.9)[:4], 0.51, *row("a", 50, 0.9)[5:]))  # another payload
    df = spark.createDataFrame(rows, schema)
    src, folder = shuffled(spark, df, "ts", 1, 3)
    out = run_available_now(ordered.reused_scores(src, "2 days"), folder, "reuse").where("store_id is not null").collect()
    first = {f"a-{t}": f"a-{f}" for t, f in ((0, 0), (100, 0), (299, 0), (300, 300), (301, 300), (500, 300), (599, 300), (600, 600), (2000, 2000))}
    first |= {"b-10": "b-10", "b-40": "b-10", "a-50": "a-50"}
    assert {r.request_id: r.id for r in out} == first and len(out) == len(rows)
    assert all(r.reused == (r.request_id != r.id) for r in out)
    assert all(r.p_final == float(r.id.split("-")[1]) / 1000 for r in out if r.store_id == "a" and r.request_id != "a-50")


def test_sessions_live_in_a_table(spark):
    turn = lambda s, i, hours, message="", **slots: (s, i, T0 + dt.timedelta(hours=hours), message, *[slots.get(c) for c in ordered.SLOTS])
    schema = "session_id string, turn int, ts timestamp, message string, " + ", ".join(
        f"{c} {'string' if c in ('industry_code', 'region_code') else 'double'}" for c in ordered.SLOTS)
    rows = [turn("x", 0, 0, sales_1m=5.0), turn("x", 1, 1, industry_code="카페"), turn("x", 2, 2, sales_1m=7.0),
            turn("y", 0, 0, cust_1m=1.0), turn("y", 1, 30, cust_3m_avg=2.0),                                 # 30 hours later: anew
            turn("z", 0, 0, sales_1m=1.0), turn("z", 1, 1, ordered.DELETE_MESSAGE), turn("w", 0, 5, region_code="강남구")]
    df = spark.createDataFrame(rows, schema)
    src, folder = shuffled(spark, df, "ts", 2, 5)
    table = SessionTable(spark, f"{folder}/table")
    assert table.live("2024-01-01").count() == 0
    run_into(ordered.session_states(src, "5 days"), table.upsert, f"{folder}/_checkpoint")
    at = "2024-01-01 20:00:00"
    assert {r.session_id for r in table.live(at).collect()} == {"x", "y", "w"}
    x = table.get("x", at).first()
    assert (x.turn, x.sales_1m, x.industry_code, x.cust_1m) == (2, 7.0, "카페", None) and "sales_1m" not in x.missing
    y = table.get("y", "2024-01-02 10:00:00").first()
    assert y.cust_1m is None and y.cust_3m_avg == 2.0
    assert {r.session_id for r in table.live("2024-01-02 04:30:00").collect()} == {"y", "w"}         # x has expired
    table.delete(spark.createDataFrame([("w",), ("nobody",)], "session_id string"), at, "1")
    table.delete(spark.createDataFrame([("w",)], "session_id string"), at, "1")
    assert table.get("w", at).count() == 0 and {r.session_id for r in table.live(at).collect()} == {"x", "y"}
    again = [("w", 9, T0 + dt.timedelta(hours=21), T0 + dt.timedelta(hours=45), False, *[None] * 7, "")]
    table.save(spark.createDataFrame(again, SESSION), "1")
    assert table.get("w", "2024-01-01 22:00:00").count() == 1
    small = table.compact("2024-01-02 06:30:00", f"{folder}/small")
    assert {r.session_id for r in small.live("2024-01-02 06:30:00").collect()} == {"y", "w"}


def test_feedback_is_appended_once(spark):
    rows = [(f"f{i}", f"s{i % 3}", None, i % 7, "ok", i % 2 == 0, T0 + dt.timedelta(hours=i), None) for i in range(40)]
    rows += [("g1", None, None, 3, "no session", None, T0, None), (None, "s", None, 3, "no id", None, T0, None), ("g2", "s", None, None, "", None, T0, None)]
    df = spark.createDataFrame(rows, FEEDBACK)
    folder = new_folder(spark, "streams")
    table = FeedbackTable(spark, f"{folder}/feedback")
    assert table.rows().count() == 0
    src = read_stream_like(spark, df, f"{folder}/in", "created_at", slices=3, files=2)
    seen = []

    def sink(batch, batch_id):
        table.append(batch, batch_id)
        table.append(batch, batch_id)  # the batch comes again, as after a failure
        seen.append(batch_id)

    run_into(src, sink, f"{folder}/_checkpoint")
    good = [r for r in rows if r[0] and r[1] and r[3] and 1 <= r[3] <= 5]
    assert len(seen) == 3 and sorted(r.id for r in table.rows().collect()) == sorted(r[0] for r in good)
    bad = {(r.id, tuple(r.reasons)) for r in table.rejected().collect()}
    assert bad >= {("g1", ("session_id",)), (None, ("id",)), ("g2", ("rating",))} and len(bad) == len(rows) - len(good)
    table.append(df.limit(0), 0)
    assert table.rows().count() < len(good)  # a batch's folder holds what its last write brought


def test_keys_share_state_calls_and_lapsed_results_are_forgotten():
    class State:
        def __init__(self):
            self.rows, self.calls = [], 0

        def appendList(self, rows):
            self.calls += 1
            self.rows = self.rows + rows

        def put(self, rows):
            self.calls += 1
            self.rows = list(rows)

        def get(self):
            self.calls += 1
            return iter(self.rows)

        def exists(self):
            return bool(self.rows)

        def clear(self):
            self.rows = []

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, []

        def getListState(self, name, _schema):
            return self.states.setdefault(name, State())

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, at):
            self.timers.append(at)

    class Time:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    p, handle = ordered.FirstResult(300), Handle()
    p.init(handle)
    minute = 60_000_000
    rows = pd.DataFrame([(m * minute, f"k{i}", f'{{"id": "{i}-{m}"}}') for i in range(500) for m in (9, 1, 0)], columns=["at", "who", "row"])
    assert not list(p.handleInputRows((0,), iter([rows.iloc[:700], rows.iloc[700:]]), None)) and handle.timers == [1]
    out = pd.concat(p.handleExpiredTimer((0,), Time(5 * 60_000), None))
    assert len(out) == 1000 and out.reused.sum() == 500 and set(out.id.str[-2:]) == {"-0"}
    assert len(handle.states["waiting"].rows) == 500 and not handle.states["kept"].rows  # five minutes have passed
    out = pd.concat(p.handleExpiredTimer((0,), Time(10 * 60_000), None))
    assert len(out) == 500 and not out.reused.any() and not handle.states["waiting"].rows
    assert len(handle.states["kept"].rows) == 500  # results of the ninth minute
    assert sum(s.calls for s in handle.states.values()) < 10
