"""Streaming queries (S1-S6): each lands a derived table as files in the shared folder, drains it as a
file stream (``availableNow``) through the streaming operator into a parquet sink with a checkpoint, and
returns the sink. Where the stream's output equals a batch result the batch SQL is the oracle."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storewatch.operators.dialogue import SLOTS, dialogue_table, parse_messages
from storewatch.plans.catalog import panel, r6, register, scored
from storewatch.plans.oracle_panel import panel_ctes
from storewatch.plans.oracle_risk import r6s, scored_ctes
from storewatch.plans.q_requests import QS_SQL
from storewatch.plans.q_text import _DLG_SQL
from storewatch.session import Scope, cut_lineage, ensure_checkpoint_dir
from storewatch.sources.requests import REQUEST_SQL, request_table
from storewatch.sources.tables import Tables
from storewatch.operators.quickscore import quickscore
from storewatch.streaming.ordered import PAYLOAD, RESULT, ordered_alerts, reused_scores, session_states, use_rocksdb
from storewatch.streaming.tables import SessionTable, run_into
from storewatch.streaming.streams import (DELETE_MESSAGE, closing_row, read_stream_like, run_available_now, stream_dedup_requests,
                                          stream_persistence_alerts, stream_quickscore, stream_slot_sessions,
                                          stream_slow_requests, stream_usage_windows, usage_events)


def _base(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def _requests_with_ts(spark, sf):
    r = request_table(panel(spark, sf))
    return r.withColumn("ts", F.to_timestamp(F.concat(F.col("target_month"), F.lit("-01"))))


@register("stream_quickscore", f"""WITH {panel_ctes()}, {QS_SQL}
SELECT store_id, target_month, Sales_Risk, Customer_Risk, Market_Risk, risk_score, {r6s('p_final')} AS p_final, alert
FROM rq""")
def q_stream_quickscore(spark, sf):
    base = _base(spark)
    src = read_stream_like(spark, _requests_with_ts(spark, sf), f"{base}/requests", "ts")
    out = run_available_now(stream_quickscore(src), base, "quickscore")
    return out.select("store_id", "target_month", "Sales_Risk", "Customer_Risk", "Market_Risk", "risk_score",
                      *r6("p_final"), "alert")


_DELETED = "(CAST(regexp_extract(session_id, '^([0-9]+)', 1) AS BIGINT) % 3 = 0 AND turn = 1)"


@register("stream_slot_sessions", f"""WITH {panel_ctes()}, {_DLG_SQL},
x AS (SELECT * EXCLUDE (message), CASE WHEN {_DELETED} THEN '{DELETE_MESSAGE}' ELSE message END AS message FROM pdm),
d AS (SELECT *, max(CASE WHEN message = '{DELETE_MESSAGE}' THEN turn END) OVER (PARTITION BY session_id) AS gone FROM x)
SELECT session_id, max(turn) AS turn,
  {', '.join(f"arg_max({s}, turn) FILTER (WHERE {s} IS NOT NULL AND turn > coalesce(gone, -1)) AS {s}" for s in SLOTS)}
FROM d GROUP BY session_id""")
def q_stream_slot_sessions(spark, sf):
    """Dialogue turns of every request session (a third of the stores delete theirs at the second turn) through the
    session state; final slots of every expired session."""
    base = _base(spark)
    turns = parse_messages(dialogue_table(request_table(panel(spark, sf))))
    gone = (F.regexp_extract("session_id", "^([0-9]+)", 1).cast("long") % 3 == 0) & (F.col("turn") == 1)
    turns = turns.withColumn("message", F.when(gone, DELETE_MESSAGE).otherwise(F.col("message")))
    src = read_stream_like(spark, turns, f"{base}/turns", "ts", closing=closing_row(turns, "ts", "3 DAYS", turn=0, message=""))
    return run_available_now(stream_slot_sessions(src), base, "sessions").select("session_id", "turn", *SLOTS)


@register("stream_dedup_requests", f"""WITH {panel_ctes()}, {REQUEST_SQL}
SELECT store_id, target_month FROM req""")
def q_stream_dedup_requests(spark, sf):
    """Every request plus a repeat two minutes later; repeats within five minutes are suppressed, so each
    request comes out once (which copy survives is not fixed, so only the request keys are returned)."""
    base = _base(spark)
    r = _requests_with_ts(spark, sf)
    both = r.unionByName(r.withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 MINUTES")))
    src = read_stream_like(spark, both, f"{base}/requests", "ts")
    out = run_available_now(stream_dedup_requests(src), base, "dedup")
    return out.select("store_id", "target_month")


@register("stream_usage_windows", """
WITH e AS (SELECT event_type AS endpoint, value AS response_time, CAST(ts AS TIMESTAMP) AS created_at FROM events)
SELECT date_trunc('day', created_at) AS window_start, date_trunc('day', created_at) + INTERVAL 1 DAY AS window_end,
  endpoint, COUNT(*) AS count, ROUND(AVG(response_time), 6) AS avg_response_time FROM e
GROUP BY 1, 2, 3""")
def q_stream_usage_windows(spark, sf):
    """Daily requests / mean response time per endpoint; a day is emitted once the watermark (latest event
    minus one day) has passed its end; the replay ends with a record that lets the newest days out."""
    base = _base(spark)
    events = usage_events(Tables(spark, sf).events)
    src = read_stream_like(spark, events, f"{base}/events", "created_at", closing=closing_row(events, "created_at", "4 DAYS"))
    out = run_available_now(stream_usage_windows(src), base, "usage")
    return out.select("window_start", "window_end", "endpoint", "count", *r6("avg_response_time"))


@register("stream_slow_requests", """
SELECT event_type AS endpoint, value AS response_time, user_id AS api_key, CAST(ts AS TIMESTAMP) AS created_at
FROM events WHERE value > 1.0""")
def q_stream_slow_requests(spark, sf):
    base = _base(spark)
    src = read_stream_like(spark, usage_events(Tables(spark, sf).events), f"{base}/events", "created_at")
    return run_available_now(stream_slow_requests(src), base, "slow")


@register("stream_persistence_alerts", f"""WITH {scored_ctes(True)},
pb AS (SELECT *, AVG(p_final) OVER (PARTITION BY ENCODED_MCT ORDER BY TA_YM ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
  AS pbar FROM scored)
SELECT ENCODED_MCT AS store_id, CAST(TA_YM AS TIMESTAMP) AS ts, ROUND(p_final, 6) AS p_final, ROUND(pbar, 6) AS pbar,
  CASE WHEN p_final >= 0.4 AND pbar >= 0.35 THEN 'RED' WHEN p_final >= 0.3 THEN 'ORANGE'
  WHEN p_final >= 0.2 THEN 'YELLOW' ELSE 'GREEN' END AS alert FROM pb""")
def q_stream_persistence_alerts(spark, sf):
    base = _base(spark)
    s = scored(spark, sf).select(F.col("ENCODED_MCT").alias("store_id"), F.col("TA_YM").cast("timestamp").alias("ts"),
                                 "p_final")
    src = read_stream_like(spark, s, f"{base}/scores", "ts")
    out = run_available_now(stream_persistence_alerts(src), base, "persistence")
    return out.select("store_id", "ts", *r6("p_final", "pbar"), "alert")


def _out_of_order(spark, rows, time: str, base: str, name: str, days: int):
    """``rows`` landed in an order that is off by up to ``days`` days, as a stream of several micro-batches.  They are worked out once: the
    span of their times, every slice and the closing row read a written table, which is dropped when all have landed."""
    use_rocksdb(spark)
    jitter = F.pmod(F.xxhash64(*rows.columns), F.lit(days * 86_400))
    with Scope(spark) as scope:
        late = scope.table(rows.withColumn("arrival", F.timestamp_micros(F.unix_micros(time) + jitter * 1_000_000)))
        end = closing_row(late, "arrival", "400 DAYS").withColumn(time, F.col("arrival"))
        return read_stream_like(spark, late, f"{base}/{name}", "arrival", closing=end)


@register("stream_ordered_alerts", f"""WITH {scored_ctes(True)},
pb AS (SELECT *, AVG(p_final) OVER (PARTITION BY ENCODED_MCT ORDER BY TA_YM ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
  AS pbar FROM scored)
SELECT ENCODED_MCT AS store_id, CAST(TA_YM AS TIMESTAMP) AS ts, ROUND(p_final, 6) AS p_final, ROUND(pbar, 6) AS pbar,
  CASE WHEN p_final >= 0.4 AND pbar >= 0.35 THEN 'RED' WHEN p_final >= 0.3 THEN 'ORANGE'
  WHEN p_final >= 0.2 THEN 'YELLOW' ELSE 'GREEN' END AS alert FROM pb""")
def q_stream_ordered_alerts(spark, sf):
    """Scores that arrive up to four months out of order, rated in order of time: the same alerts as the batch."""
    base = _base(spark)
    s = scored(spark, sf).select(F.col("ENCODED_MCT").alias("store_id"), F.col("TA_YM").cast("timestamp").alias("ts"), "p_final")
    src = _out_of_order(spark, s, "ts", base, "scores", 120)
    out = run_available_now(ordered_alerts(src, "130 days"), base, "alerts")
    return out.select("store_id", "ts", *r6("p_final", "pbar"), "alert")


_OFFSETS = (0, 2, 4, 6, 9, 13)   # minutes after the first request; a result is kept for five
_FIRST = {0: 0, 2: 0, 4: 0, 6: 6, 9: 6, 13: 13}


@register("stream_reused_results", f"""WITH {panel_ctes()}, {QS_SQL}
SELECT store_id, target_month, o.minutes, o.first AS result_of, o.minutes <> o.first AS reused, Sales_Risk, Customer_Risk, Market_Risk, risk_score,
  {r6s('p_final')} AS p_final, alert
FROM rq, (VALUES {', '.join(f'({a}, {b})' for a, b in _FIRST.items())}) o(minutes, first)""")
def q_stream_reused_results(spark, sf):
    """Every request six times within a quarter of an hour, arriving out of order: equal requests within five minutes of a scored one
    get its result."""
    base = _base(spark)
    r = _requests_with_ts(spark, sf).withColumn("minutes", F.explode(F.array(*[F.lit(m) for m in _OFFSETS])))
    r = r.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("minutes") * 60_000_000))
    q = quickscore(r).withColumn("id", F.col("minutes").cast("string"))
    q = q.select(*PAYLOAD, "ts", "id", *RESULT)
    out = run_available_now(reused_scores(_out_of_order(spark, q, "ts", base, "requests", 1), "2 days"), base, "reused")
    return out.where("store_id is not null").select(
        "store_id", "target_month", F.col("request_id").cast("int").alias("minutes"), F.col("id").cast("int").alias("result_of"), "reused",
        "Sales_Risk", "Customer_Risk", "Market_Risk", "risk_score", *r6("p_final"), "alert")


@register("session_table", f"""WITH {panel_ctes()}, {_DLG_SQL},
x AS (SELECT * EXCLUDE (message), CASE WHEN {_DELETED} THEN '{DELETE_MESSAGE}' ELSE message END AS message,
  CAST(strptime(split_part(session_id, '/', 2) || '-01', '%Y-%m-%d') AS TIMESTAMP) + to_minutes(turn) AS ts FROM pdm),
d AS (SELECT *, max(CASE WHEN message = '{DELETE_MESSAGE}' THEN turn END) OVER (PARTITION BY session_id) AS gone, max(ts) OVER () AS now FROM x),
f AS (SELECT session_id, max(turn) AS turn, any_value(gone) AS gone, max(ts) + INTERVAL 24 HOUR > any_value(now) AS fresh,
    CAST(regexp_extract(session_id, '^([0-9]+)', 1) AS BIGINT) % 4 = 0 AS asked,
  {', '.join(f"arg_max({s}, turn) FILTER (WHERE {s} IS NOT NULL AND turn > coalesce(gone, -1)) AS {s}" for s in SLOTS)}
  FROM d GROUP BY session_id)
SELECT session_id, CASE WHEN asked OR turn = gone THEN 'deleted' WHEN fresh THEN 'live' ELSE 'expired' END AS status,
  CASE WHEN NOT asked THEN turn END AS turn, {', '.join(f"CASE WHEN NOT asked THEN {s} END AS {s}" for s in SLOTS)} FROM f""")
def q_session_table(spark, sf):
    """Dialogue turns, out of order, through the session states into the session table; then the sessions of every fourth store are
    deleted (twice, which changes nothing).  The last state of every session as of the newest message."""
    base = _base(spark)
    turns = parse_messages(dialogue_table(request_table(panel(spark, sf))))
    gone = (F.regexp_extract("session_id", "^([0-9]+)", 1).cast("long") % 3 == 0) & (F.col("turn") == 1)
    turns = turns.withColumn("message", F.when(gone, DELETE_MESSAGE).otherwise(F.col("message"))).withColumn("ts", F.col("ts").cast("timestamp"))
    turns = cut_lineage(turns.select("session_id", "turn", "ts", "message", *SLOTS))   # the stream, the newest time and two deletions read it
    table = SessionTable(spark, f"{base}/sessions")
    run_into(session_states(_out_of_order(spark, turns, "ts", base, "turns", 2), "3 days"), table.upsert, f"{base}/_checkpoint")
    now = turns.agg(F.max("ts").cast("string")).first()[0]
    asked = turns.where(F.regexp_extract("session_id", "^([0-9]+)", 1).cast("long") % 4 == 0)
    for _ in range(2):
        table.delete(asked, now, "every-fourth")
    status = F.when(F.col("deleted"), "deleted").when(F.col("expires_at") > F.lit(now).cast("timestamp"), "live").otherwise("expired")
    return table.states().select("session_id", status.alias("status"), "turn", *SLOTS)
