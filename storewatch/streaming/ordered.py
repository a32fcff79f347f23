"""Keyed streams that are read in order of event time, whatever order their rows arrive in (``transformWithState``).

Rows wait in list state until the watermark has passed them; an event-time timer then hands them on in order of time.  A state call
costs the same for one row as for thousands, so keys share state by a hash (``BUCKETS``): a call serves all keys of a bucket, and the rows
of a bucket travel and wait as packs (:func:`packs`, :class:`Packed`).  A pack counts as late by its newest row; an older row in it is dropped
only when its bucket has handed on later ones.
Every processor here keeps its own result state beside the waiting rows; both live in the RocksDB state store, so they
survive a lost executor with the query's checkpoint.  What no later row can ask for is forgotten.

- :func:`ordered_alerts` (S5): alert with persistence over a store's last three scores, in order of time.
- :func:`reused_scores` (S3): a request that repeats within five minutes gets the first one's result.
- :func:`session_states` (A11): the slots of a chat session after every message, with time to live and deletion.
"""
from __future__ import annotations

import json
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from storewatch.constants import REQUIRED_SLOTS, THRESHOLDS
from storewatch.operators.blocks import limit_batches
from storewatch.operators.dialogue import SLOTS

DELETE_MESSAGE = "__delete__"
BUCKETS = 1024  # keys of one bucket are held in a task together; a stream's checkpoint is tied to the number
OUT_ROWS = 10_000
GATHERED = 200_000  # rows that a task packs at a time
PACK_ROWS = 5_000   # rows of a pack in the state at most
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """``transformWithState`` keeps its state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _millis(t: pd.Timestamp) -> int:
    return int(t.value // 1_000_000)


class InOrder(StatefulProcessor):
    """Hands the rows of a key to :meth:`rate` once the watermark has passed them, oldest first; the state is that of a bucket of keys.

    Rows travel as (time in microseconds, key, JSON of the other columns); rows of one time go by their JSON."""

    numbers: tuple = ()  # result columns of doubles

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, who string, row string")
        self.kept = handle.getListState("kept", "who string, value string")

    def rate(self, key: tuple, rows: list[tuple[int, dict]], kept) -> tuple[list[dict], object]:
        """Result rows, and what to keep for the key (JSON-like; None: nothing)."""
        raise NotImplementedError

    def lapsed(self, kept, passed: int) -> bool:
        """Whether rows from ``passed`` on cannot depend on ``kept`` any more."""
        return False

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(at), who, row) for pdf in rows for at, who, row in zip(pdf["at"], pdf["who"], pdf["row"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self._wake(min(at for at, _, _ in new))
        yield from ()

    def _wake(self, at: int) -> None:
        """A timer right behind ``at``, unless an earlier one will look anyway."""
        if min(self.handle.listTimers(), default=at // 1000 + 2) > at // 1000 + 1:
            self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = {}, []
        for at, who, row in self.waiting.get():
            if at < passed:
                ready.setdefault(who, []).append((int(at), row))
            else:
                later.append((int(at), who, row))
        if not ready:
            return
        kept = {who: json.loads(value) for who, value in self.kept.get()} if self.kept.exists() else {}
        out = []
        for who in sorted(ready):
            made, left = self.rate((who,), [(at, json.loads(row)) for at, row in sorted(ready.pop(who))], kept.pop(who, None))
            out += made
            if left is not None:
                kept[who] = left
            if len(out) >= OUT_ROWS:
                yield self._frame(out)
                out = []
        kept = [(who, json.dumps(value)) for who, value in kept.items() if not self.lapsed(value, passed)]
        for state, rows in ((self.waiting, later), (self.kept, kept)):
            if rows:
                state.put(rows)
            else:
                state.clear()
        if later:
            self.handle.registerTimer(min(at for at, _, _ in later) // 1000 + 1)
        if out:
            yield self._frame(out)

    def _frame(self, out: list) -> pd.DataFrame:
        made = pd.DataFrame(out)
        return made.astype({c: "float64" for c in self.numbers if c in made})

    def close(self) -> None:
        pass


def pack_rows(at: np.ndarray, who: list, row: list) -> list[tuple[int, bytes]]:
    """Earliest time and content of packs of at most ``PACK_ROWS`` rows."""
    return [(int(at[i:i + PACK_ROWS].min()), pickle.dumps((at[i:i + PACK_ROWS].astype("<i8").tobytes(), who[i:i + PACK_ROWS], row[i:i + PACK_ROWS]), 5))
            for i in range(0, len(at), PACK_ROWS)]


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, who, at, row) as packs by key: key, low (earliest time of the pack), ts (its latest), pack.  Rows without a time go; rows
    without a key leave their latest time."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        t = t.filter(t.column("at").is_valid())
        key = t.column("key").fill_null(-1).to_numpy()
        order = np.argsort(key, kind="stable")
        key, at = key[order], t.column("at").to_numpy()[order]
        who, row = t.column("who").take(order).to_pylist(), t.column("row").take(order).to_pylist()
        out: dict = {"key": [], "low": [], "ts": [], "pack": []}
        edges = np.concatenate([np.flatnonzero(np.diff(key, prepend=-2)), [len(key)]])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            mine = pack_rows(at[lo:hi], who[lo:hi], row[lo:hi]) if key[lo] >= 0 else [(0, b"")]
            out["low"] += [low for low, _ in mine]
            out["pack"] += [pack for _, pack in mine]
            out["key"] += [int(key[lo]) if key[lo] >= 0 else None] * len(mine)
            out["ts"] += [int(at[lo:hi].max())] * len(mine)
        return pa.RecordBatch.from_pydict({"key": pa.array(out["key"], pa.int32()), "low": pa.array(out["low"], pa.int64()),
                                           "ts": pa.array(out["ts"], pa.int64()).cast(pa.timestamp("us", "UTC")), "pack": pa.array(out["pack"], pa.binary())})

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            yield flush()
    if held:
        yield flush()


class Packed(StatefulProcessor):
    """What ``rules`` says of rows in order of time (:class:`InOrder`), with rows and what is kept of them in packs."""

    def __init__(self, rules: InOrder):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rules.handle = self.handle = handle
        self.waiting = handle.getListState("waiting", "low long, pack binary")
        self.kept = handle.getValueState("kept", "passed long, pack binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(low), bytes(pack)) for pdf in rows for low, pack in zip(pdf["low"], pdf["pack"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self.rules._wake(min(low for low, _ in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        before, kept = None, {}
        if self.kept.exists():
            before, pack = self.kept.get()
            if before >= passed:
                return  # an earlier timer of this batch has seen to all
            kept = pickle.loads(bytes(pack))  # noqa: S301 - written here
        ready, later = {}, ([], [], [])
        for _, pack in self.waiting.get():
            at, who, row = pickle.loads(bytes(pack))  # noqa: S301 - written by packs
            for a, w, r in zip(np.frombuffer(at, "<i8").tolist(), who, row, strict=True):
                if a >= passed:
                    for column, value in zip(later, (a, w, r), strict=True):
                        column.append(value)
                elif before is None or a >= before:
                    ready.setdefault(w, []).append((a, r))
        out = []
        for who in sorted(ready):
            made, left = self.rules.rate((who,), [(at, json.loads(row)) for at, row in sorted(ready.pop(who))], kept.pop(who, None))
            out += made
            if left is not None:
                kept[who] = left
            if len(out) >= OUT_ROWS:
                yield self.rules._frame(out)
                out = []
        self.kept.update((passed, pickle.dumps({who: value for who, value in kept.items() if not self.rules.lapsed(value, passed)}, 5)))
        if later[0]:
            rest = pack_rows(np.array(later[0], np.int64), later[1], later[2])
            self.waiting.put(rest)
            self.handle.registerTimer(min(low for low, _ in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        if out:
            yield self.rules._frame(out)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, time: str, columns: list, delay: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """``stream`` through ``processor``, by key, in order of ``time``; rows more than ``delay`` behind the newest are dropped."""
    # the query's helper process on the driver does not see files sent to the workers: it gets the classes themselves
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    who = F.col(key).cast("string")
    bucket = F.when(who.isNotNull(), F.pmod(F.xxhash64(who), F.lit(BUCKETS)).cast("int"))
    limit_batches(stream.sparkSession)
    rows = stream.select(bucket.alias("key"), who.alias("who"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"),
                         F.to_json(F.struct(*columns)).alias("row"))
    packed = rows.mapInArrow(packs, "key int, low long, ts timestamp, pack binary")
    # the condition names ts so that it stays behind the watermark, which rows without a key move too
    kept = packed.withWatermark("ts", delay).where("if(ts is null, false, key is not null)")
    return kept.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Packed(processor), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class Alerts(InOrder):
    numbers = ("p_final", "pbar")

    def rate(self, key, rows, kept):
        k = int(THRESHOLDS["persistence_k"])
        last, out = list(kept or []), []
        for at, row in rows:
            p = row.get("p_final")
            if p is None:
                continue
            last = [*last, p][-k:]
            pbar = float(np.mean(last))
            red = p >= THRESHOLDS["red"] and pbar >= THRESHOLDS["red"] - THRESHOLDS["delta"]
            alert = "RED" if red else "ORANGE" if p >= THRESHOLDS["orange"] else "YELLOW" if p >= THRESHOLDS["yellow"] else "GREEN"
            out.append({"store_id": key[0], "ts": pd.Timestamp(at, unit="us"), "p_final": p, "pbar": pbar, "alert": alert})
        return out, last


def ordered_alerts(scores: DataFrame, delay: str) -> DataFrame:
    """``scores``: store_id, ts, p_final, in any order within ``delay``.  Rows without a score get no alert and leave no trace."""
    return in_order(scores, "store_id", "ts", ["p_final"], delay, Alerts(),
                    "store_id string, ts timestamp, p_final double, pbar double, alert string")


PAYLOAD = ["store_id", "target_month", "region_code", "industry_code", "delivery_share", "sales_1m", "sales_3m_avg", "cust_1m", "cust_3m_avg"]
RESULT = ["Sales_Risk", "Customer_Risk", "Market_Risk", "risk_score", "p_final", "alert"]


class FirstResult(InOrder):
    numbers = tuple(RESULT[:-1])

    def __init__(self, within_s: int):
        self.within = within_s * 1_000_000

    def lapsed(self, kept, passed):
        return passed - kept["at"] >= self.within

    def rate(self, key, rows, kept):
        out = []
        for at, row in rows:
            reused = kept is not None and at - kept["at"] < self.within
            if not reused:
                kept = {"at": at, **{c: row.get(c) for c in ("id", *RESULT)}}
            out.append({"request_id": row.get("id"), "store_id": row.get("store_id"), "target_month": row.get("target_month"),
                        "ts": pd.Timestamp(at, unit="us"), "id": kept["id"], "scored_at": pd.Timestamp(kept["at"], unit="us"),
                        **{c: kept[c] for c in RESULT}, "reused": reused})
        return out, kept


def reused_scores(scored: DataFrame, delay: str, within_s: int = 300) -> DataFrame:
    """One row per request with a result: its own, or that of the first equal request less than ``within_s`` seconds before (a result
    is kept that long, however often it is reused).

    ``scored``: request columns, ts, id (of the request) and the scores; the payload is the request without ts and id."""
    keyed = scored.withColumn("_payload", F.sha2(F.to_json(F.struct(*PAYLOAD), {"ignoreNullFields": "false"}), 256))
    return in_order(keyed, "_payload", "ts", ["id", "store_id", "target_month", *RESULT], delay, FirstResult(within_s),
                    "request_id string, store_id string, target_month string, ts timestamp, id string, scored_at timestamp, "
                    "Sales_Risk double, Customer_Risk double, Market_Risk double, risk_score double, p_final double, alert string, reused boolean")


class Sessions(InOrder):
    numbers = tuple(s for s in SLOTS if s not in ("industry_code", "region_code"))

    def __init__(self, ttl_s: int):
        self.ttl = ttl_s * 1_000_000

    def lapsed(self, kept, passed):
        return passed >= kept["until"]

    def rate(self, key, rows, kept):
        out = []
        for at, row in rows:
            if kept is None or at >= kept["until"]:
                kept = {"slots": {}}
            gone = row.get("message") == DELETE_MESSAGE
            slots = {} if gone else {**kept["slots"], **{s: row[s] for s in SLOTS if row.get(s) is not None}}
            kept = {"slots": slots, "until": at + self.ttl}
            out.append({"session_id": key[0], "turn": row.get("turn"), "ts": pd.Timestamp(at, unit="us"),
                        "expires_at": pd.Timestamp(kept["until"], unit="us"), "deleted": gone, **{s: slots.get(s) for s in SLOTS},
                        "missing": ",".join(s for s in REQUIRED_SLOTS if slots.get(s) is None)})
        return out, kept


def session_states(turns: DataFrame, delay: str, ttl_s: int = 24 * 3600) -> DataFrame:
    """The slots of a session after each message: later values replace earlier ones, a delete message empties them, and a message
    that comes ``ttl_s`` after the one before begins anew.  Sink: ``streaming.tables.SessionTable``."""
    kinds = {s: "string" if s in ("industry_code", "region_code") else "double" for s in SLOTS}
    return in_order(turns, "session_id", "ts", ["turn", "message", *SLOTS], delay, Sessions(ttl_s),
                    "session_id string, turn int, ts timestamp, expires_at timestamp, deleted boolean, "
                    + ", ".join(f"{s} {k}" for s, k in kinds.items()) + ", missing string")
