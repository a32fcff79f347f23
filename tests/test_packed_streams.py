"""Rows of a stream in packs: what is packed comes back, state calls follow packs, a stream's rows are worked out once."""
import datetime as dt
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from storewatch.plans import q_streams
from storewatch.session import new_folder
from storewatch.streaming import ordered


def batch(rows):
    key, who, at, row = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int32()), "who": pa.array(who), "at": pa.array(at, pa.int64()), "row": pa.array(row)})


def test_rows_come_back_from_packs():
    rng = np.random.default_rng(0)
    rows = [(int(k), f"w{i % 50}", int(rng.integers(1, 10**12)), f'{{"i":{i}}}') for i, k in enumerate(rng.integers(0, 7, 13_000))]
    rows += [(None, None, 10**13, "{}"), (3, "w", None, "{}")]
    old, ordered.PACK_ROWS = ordered.PACK_ROWS, 500
    try:
        out = pa.Table.from_batches(ordered.packs(iter([batch(rows[:6000]), batch(rows[6000:])]))).to_pylist()
    finally:
        ordered.PACK_ROWS = old
    back = []
    for r in out:
        if r["key"] is None:
            assert r["ts"] == dt.datetime.fromtimestamp(10**7, dt.timezone.utc)
            continue
        at, who, row = pickle.loads(r["pack"])
        at = np.frombuffer(at, "<i8")
        assert len(at) <= 500 and r["low"] == at.min()
        back += [(r["key"], w, int(a), x) for w, a, x in zip(who, at, row, strict=True)]
    assert sorted(back) == sorted(rows[:-2]) and len(out) < 40
    assert not list(ordered.packs(iter([])))


class State:
    def __init__(self):
        self.rows, self.calls = [], 0

    def appendList(self, rows):  # noqa: N802
        self.calls += 1
        self.rows = self.rows + rows

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def update(self, row):
        self.put([row])

    def exists(self):
        return bool(self.rows)

    def clear(self):
        self.rows = []


class Many(State):
    def get(self):
        return iter(self.rows)


class One(State):
    def get(self):
        return self.rows[0]


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, _schema):  # noqa: N802
        return self.states.setdefault(name, Many())

    def getValueState(self, name, _schema):  # noqa: N802
        return self.states.setdefault(name, One())

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class Time:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_packs_wait_and_are_rated_in_order():
    p, handle, minute = ordered.Packed(ordered.FirstResult(300)), Handle(), 60_000_000
    p.init(handle)
    rows = [(0, f"k{i}", m * minute, f'{{"id": "{i}-{m}"}}') for i in range(500) for m in (9, 1, 0)]
    frames = [pa.Table.from_batches(ordered.packs(iter([batch(part)]))).to_pandas() for part in (rows[:700], rows[700:])]
    assert not list(p.handleInputRows((0,), iter(frames), None)) and handle.timers == [1]
    (out,) = p.handleExpiredTimer((0,), Time(5 * 60_000), None)
    assert len(out) == 1000 and out.reused.sum() == 500 and set(out.id.str[-2:]) == {"-0"}
    assert len(handle.states["waiting"].rows) == 1                                  # 500 rows of the ninth minute
    assert pickle.loads(handle.states["kept"].get()[1]) == {}                        # five minutes have passed
    assert not list(p.handleExpiredTimer((0,), Time(5 * 60_000), None))              # another timer of the same time
    late = pa.Table.from_batches(ordered.packs(iter([batch([(0, "k1", 2 * minute, '{"id": "late"}')])]))).to_pandas()
    list(p.handleInputRows((0,), iter([late]), None))
    (out,) = p.handleExpiredTimer((0,), Time(10 * 60_000), None)
    assert len(out) == 500 and not out.reused.any() and not handle.states["waiting"].rows
    assert len(pickle.loads(handle.states["kept"].get()[1])) == 500
    assert sum(s.calls for s in handle.states.values()) < 8


def test_stream_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(200, numPartitions=2).select(F.col("id").cast("string").alias("store_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    rows = rows.mapInArrow(count, "store_id string, ts timestamp")
    base = new_folder(spark, "streams")
    q_streams._out_of_order(spark, rows, "ts", base, "rows", 2)
    assert seen.value == 200 and spark.read.parquet(f"{base}/rows").count() == 201
