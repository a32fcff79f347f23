"""Structured Streaming versions of the request-side behaviour.

- S1 ``stream_quickscore``: score each arriving request, append to a sink.
- S2 ``stream_slot_sessions``: slot state of a session with a 24 h TTL renewed by every message and an explicit
  delete message: an event-time session window, its aggregates are the state (JVM only); a row per session comes
  out when the watermark passes its expiry.
- S3 ``stream_dedup_requests``: repeats of the same payload within 5 minutes are suppressed
  (``dropDuplicatesWithinWatermark`` on the payload columns themselves).
- S4 ``stream_usage_windows``: requests and mean response time per endpoint per day (tumbling window,
  watermark, append mode).
- S5 ``stream_persistence_alerts``: per store, the last three scores in state; alert on each arrival (scores
  arriving late are rated against the state of their arrival; rows without a score get no alert and leave no
  trace in the state).
- S6 ``stream_slow_requests``: requests slower than 1 s.

Every function takes a streaming DataFrame and returns one; :func:`run_available_now` drains a source
into a parquet sink with a checkpoint (exactly-once file sink) and returns the sink as a batch frame.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from storewatch.constants import REQUIRED_SLOTS, THRESHOLDS
from storewatch.operators.dialogue import SLOTS
from storewatch.operators.quickscore import quickscore

DELETE_MESSAGE = "__delete__"
SLOW_SECONDS = 1.0


def run_available_now(stream: DataFrame, base: str, name: str, mode: str = "append") -> DataFrame:
    """Process everything available, however long it takes, and read the file sink back."""
    spark = stream.sparkSession
    out, ckpt = f"{base}/{name}/out", f"{base}/{name}/_checkpoint"
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()     # raises what the stream raised
    return spark.read.schema(stream.schema).parquet(out)


def read_stream_like(spark: SparkSession, batch: DataFrame, path: str, time_col: str, slices: int = 4,
                     files: int = 4, closing: DataFrame | None = None) -> DataFrame:
    """Land a batch table in order of ``time_col`` as ``slices`` sets of ``files`` files each, and open them as a file
    stream that takes one set per micro-batch, so that state really crosses batches.

    ``closing``: rows landed last, with times beyond everything else; they move the watermark so that every
    window of the table ends and comes out (their own windows never do)."""
    seconds = F.col(time_col).cast("timestamp").cast("double")
    lo, hi = batch.agg(F.min(seconds), F.max(seconds)).first()
    step = ((hi or 0.0) - (lo or 0.0)) / slices or 1.0
    part = F.coalesce(F.least(F.floor((seconds - F.lit(lo or 0.0)) / F.lit(step)), F.lit(slices - 1)), F.lit(0))
    parts = [batch.where(part == i) for i in range(slices)] + ([closing] if closing is not None else [])
    for rows in parts:
        rows.repartition(files).write.mode("append").option("maxRecordsPerFile", 0).parquet(path)
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def closing_row(batch: DataFrame, time_col: str, gap: str, **values) -> DataFrame:
    """One row of the table's schema, ``gap`` behind its latest time (the other columns null unless given)."""
    last = batch.agg(F.max(F.col(time_col).cast("timestamp")).alias("t")).select(
        (F.col("t") + F.expr(f"INTERVAL {gap}")).alias("t")).where(F.col("t").isNotNull())
    cols = [F.col("t").cast(f.dataType).alias(f.name) if f.name == time_col
            else F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in batch.schema.fields]
    return last.select(*cols)


# --- S1 ------------------------------------------------------------------------------------------
def stream_quickscore(requests: DataFrame) -> DataFrame:
    q = quickscore(requests)
    return q.select("store_id", "target_month", "ts", "Sales_Risk", "Customer_Risk", "Market_Risk", "risk_score",
                    "p_final", "alert", F.concat_ws(" | ", "explanations").alias("explanations"),
                    F.concat_ws(" | ", "recommendations").alias("recommendations"),
                    F.sha2(F.to_json(F.struct("store_id", "target_month", "ts")), 256).alias("id"))


# --- S2 ------------------------------------------------------------------------------------------
def stream_slot_sessions(parsed_turns: DataFrame, ttl: str = "24 hours", lateness: str = "1 hour") -> DataFrame:
    """``parsed_turns``: session_id, turn, ts, message + the seven parsed slot columns.

    One row per expired session: its last turn, the last non-missing value of every slot after the last delete
    message, the required slots still missing, and the expiry time (last message + ttl)."""
    deleted = F.max(F.when(F.col("message") == DELETE_MESSAGE, F.col("turn"))).alias("_deleted")
    aggs = []
    for s in SLOTS:
        told = F.when(F.col(s).isNotNull() & (F.col("message") != DELETE_MESSAGE), F.col("turn"))
        aggs += [F.max_by(F.col(s), told).alias(f"_v_{s}"), F.max(told).alias(f"_t_{s}")]
    state = (parsed_turns.withWatermark("ts", lateness)
             .groupBy("session_id", F.session_window("ts", ttl).alias("w"))
             .agg(F.max("turn").alias("turn"), deleted, *aggs))
    slots = {s: F.when(F.col(f"_t_{s}") > F.coalesce("_deleted", F.lit(-1)), F.col(f"_v_{s}")) for s in SLOTS}
    filled = state.select("session_id", "turn", *[v.alias(s) for s, v in slots.items()], F.col("w.end").alias("expired_at"))
    missing = F.concat_ws(",", *[F.when(F.col(s).isNull(), F.lit(s)) for s in REQUIRED_SLOTS])
    return filled.withColumn("missing", missing)


# --- S3 ------------------------------------------------------------------------------------------
def stream_dedup_requests(requests: DataFrame, within_s: int = 300) -> DataFrame:
    """Suppress a request that repeats within ``within_s`` seconds of event time.

    The state of a payload ends when the watermark passes its time plus the watermark's delay, and the watermark trails
    the latest event by the same delay: with half of ``within_s`` as delay a payload is forgotten once events
    ``within_s`` newer have arrived (rows up to half of it late still count)."""
    payload = ["store_id", "target_month", "region_code", "industry_code", "delivery_share", "sales_1m",
               "sales_3m_avg", "cust_1m", "cust_3m_avg"]
    return requests.withWatermark("ts", f"{within_s / 2} seconds").dropDuplicatesWithinWatermark(payload)


# --- S4 / S6 -------------------------------------------------------------------------------------
def usage_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("endpoint"), F.col("value").alias("response_time"),
                         F.col("user_id").alias("api_key"), F.col("ts").cast("timestamp").alias("created_at"))


def stream_usage_windows(usage: DataFrame, window: str = "1 day", lateness: str = "1 day") -> DataFrame:
    return (usage.withWatermark("created_at", lateness)
            .groupBy(F.window("created_at", window).alias("w"), "endpoint")
            .agg(F.count(F.lit(1)).alias("count"), F.avg("response_time").alias("avg_response_time"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "endpoint", "count",
                    "avg_response_time"))


def stream_slow_requests(usage: DataFrame, threshold_s: float = SLOW_SECONDS) -> DataFrame:
    return usage.where(F.col("response_time") > threshold_s)


# --- S5 ------------------------------------------------------------------------------------------
ALERT_OUT = T.StructType([T.StructField("store_id", T.StringType()), T.StructField("ts", T.TimestampType()),
                          T.StructField("p_final", T.DoubleType()), T.StructField("pbar", T.DoubleType()),
                          T.StructField("alert", T.StringType())])
ALERT_STATE = T.StructType([T.StructField("last", T.ArrayType(T.DoubleType()))])


def _persistence_update(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (store_id,) = key
    k = int(THRESHOLDS["persistence_k"])
    last = list(state.get[0]) if state.exists else []
    # Spark cuts a store's rows of the micro-batch into chunks at any place and in any order: sort them as one (16 bytes a row)
    chunks = [pdf.loc[pdf["p_final"].notna(), ["ts", "p_final"]] for pdf in pdfs]
    chunks = [c for c in chunks if len(c)]
    if chunks:
        rows = pd.concat(chunks, ignore_index=True).sort_values("ts", kind="stable")
        p = pd.Series([*last, *rows["p_final"]], dtype="float64")
        pbar = p.rolling(k, min_periods=1).mean().to_numpy()[len(last):]
        now = rows["p_final"].to_numpy()
        red = (now >= THRESHOLDS["red"]) & (pbar >= THRESHOLDS["red"] - THRESHOLDS["delta"])
        alert = np.select([red, now >= THRESHOLDS["orange"], now >= THRESHOLDS["yellow"]], ["RED", "ORANGE", "YELLOW"], "GREEN")
        last = p.iloc[-k:].tolist()
        yield pd.DataFrame({"store_id": store_id, "ts": rows["ts"].to_numpy(), "p_final": now, "pbar": pbar, "alert": alert})
    state.update((last,))


def stream_persistence_alerts(scores: DataFrame) -> DataFrame:
    """``scores``: store_id, ts, p_final. State per store = its last three scores."""
    return scores.groupBy("store_id").applyInPandasWithState(
        _persistence_update, ALERT_OUT, ALERT_STATE, "append", GroupStateTimeout.NoTimeout)
