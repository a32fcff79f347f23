"""Chat sessions as tables: per-turn parse, slot filling (later values overwrite earlier ones), missing
slots with follow-up questions, and the reply text.

A session's turns are bounded (a session expires 24 h after its last save), so the slot-filling window
partitions by session."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storewatch.constants import ALERT_EMOJI, FOLLOW_UP_QUESTIONS, REQUIRED_SLOTS
from storewatch.functions.text import parse_utterance_cols
from storewatch.operators.quickscore import quickscore

SLOTS = ["sales_1m", "sales_3m_avg", "cust_1m", "cust_3m_avg", "industry_code", "region_code", "delivery_share"]


def parse_messages(df: DataFrame, text_col: str = "message") -> DataFrame:
    return df.withColumns(parse_utterance_cols(F.col(text_col)))


def fill_slots(parsed: DataFrame, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """Session state after each turn: the last non-missing value of every slot so far."""
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parsed.withColumns({s: F.last(s, ignorenulls=True).over(w) for s in SLOTS})


def missing_slots(state: DataFrame) -> DataFrame:
    """``missing`` (required slots still empty, in order) and up to three follow-up ``questions``."""
    qmap = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in FOLLOW_UP_QUESTIONS.items()))
    missing = F.filter(F.array(*[F.when(F.col(s).isNull(), F.lit(s)) for s in REQUIRED_SLOTS]), lambda x: x.isNotNull())
    d = state.withColumn("missing", missing)
    return d.withColumn("questions", F.transform(F.slice("missing", 1, 3), lambda x: F.coalesce(F.element_at(qmap, x), x)))


def _pct1(x: Column) -> Column:
    return F.format_string("%.1f%%", F.round(x * F.lit(100.0), 1))


def _bullets(arr: Column, n: int) -> Column:
    return F.concat_ws("\n", F.transform(F.slice(arr, 1, n), lambda x: F.concat(F.lit("• "), x)))


def chat_reply(state: DataFrame) -> DataFrame:
    """Reply per turn: ask for missing information, or the scored summary once all required slots exist."""
    d = missing_slots(state)
    d = quickscore(d)
    emoji = F.coalesce(F.element_at(F.create_map(*chain.from_iterable(
        (F.lit(k), F.lit(v)) for k, v in ALERT_EMOJI.items())), F.col("alert")), F.lit("⚪"))
    scored_text = F.concat(
        emoji, F.lit(" **위험도: "), _pct1(F.col("p_final")), F.lit("** (경보: "), F.col("alert"), F.lit(")\n\n"),
        F.lit("📊 세부 위험도:\n- 매출: "), _pct1(F.col("Sales_Risk")), F.lit("\n- 고객: "), _pct1(F.col("Customer_Risk")),
        F.lit("\n- 시장: "), _pct1(F.col("Market_Risk")), F.lit("\n\n💡 주요 인사이트:\n"), _bullets(F.col("explanations"), 3),
        F.lit("\n\n🎯 개선 제안:\n"), _bullets(F.col("recommendations"), 2))
    ask = F.concat(F.lit("정보를 더 알려주세요: "), F.concat_ws(", ", "questions"))
    return d.withColumns({"needs_more_info": F.size("missing") > 0,
                          "reply": F.when(F.size("missing") > 0, ask).otherwise(F.trim(scored_text))})


def dialogue_table(requests: DataFrame) -> DataFrame:
    """Three user turns per request: industry, region and last month's sales; the three-month average;
    a correction of last month's sales."""
    man = lambda e: F.format_string("%d", F.round(e / 10000).cast("long"))
    sid = F.concat_ws("/", "store_id", "target_month")
    t0 = F.concat(F.col("industry_code"), F.lit("집 "), F.col("region_code"), F.lit("에서 지난달 매출 "),
                  man(F.col("sales_1m")), F.lit("만원"))
    t1 = F.concat(F.lit("최근 3개월 평균 매출 "), man(F.col("sales_3m_avg")), F.lit("만원"))
    t2 = F.concat(F.lit("아 지난달 매출 "), man(F.col("sales_1m") * F.lit(1.1)), F.lit("만원으로 정정할게요"))
    turns = F.array(*[F.struct(F.lit(i).alias("turn"), t.alias("message")) for i, t in enumerate((t0, t1, t2))])
    start = F.to_timestamp(F.concat(F.col("target_month"), F.lit("-01")))
    return (requests.select(sid.alias("session_id"), start.alias("_t0"), F.explode(turns).alias("m"))
            .select("session_id", "m.*", (F.col("_t0") + F.make_interval(mins=F.col("m.turn"))).alias("ts")))
