"""Text queries: money amounts, utterance parsing, dialogue slot filling, follow-ups and replies."""
from __future__ import annotations

from pyspark.sql import functions as F

from storewatch.constants import (ALERT_EMOJI, DELIVERY_PHRASES, FOLLOW_UP_QUESTIONS, INDUSTRY_KEYWORDS,
                                  MONEY_UNITS, REQUIRED_SLOTS)
from storewatch.functions.text import (P_AMOUNT, P_CUST_1M, P_CUST_3M, P_DELIVERY, P_REGION, P_SALES_1M, P_SALES_3M,
                                       P_SALES_ANY, money_value)
from storewatch.operators.dialogue import SLOTS, chat_reply, dialogue_table, fill_slots, missing_slots, parse_messages
from storewatch.plans.catalog import panel, register
from storewatch.plans.oracle_panel import panel_ctes
from storewatch.sources.requests import REQUEST_SQL, request_table, utterance_table
from storewatch.sources.tables import Tables


def _re(p: str) -> str:
    """Java pattern -> RE2: drop the Unicode-classes flag (RE2 reads (?U) as 'ungreedy')."""
    return p.replace("(?U)", "").replace("'", "''")


def _money_sql(e: str) -> str:
    t = f"trim(replace({e}, ',', ''))"
    num = f"TRY_CAST(NULLIF(regexp_extract({t}, '{_re(P_AMOUNT)}', 1), '') AS DOUBLE)"
    unit = f"COALESCE(NULLIF(regexp_extract({t}, '{_re(P_AMOUNT)}', 2), ''), '원')"
    mult = "CASE " + unit + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MONEY_UNITS.items()) + " END"
    return f"({num} * {mult})"


def _grp(text: str, p: str, g: int) -> str:
    return f"NULLIF(regexp_extract({text}, '{_re(p)}', {g}), '')"


def _contains_any(text: str, words) -> str:
    return " OR ".join(f"contains({text}, '{w}')" for w in words)


def parse_sql(text: str) -> str:
    """Select list parsing ``text`` into the seven slots."""
    t = f"trim({text})"
    ind = "CASE " + " ".join(f"WHEN {_contains_any(t, ws)} THEN '{k}'" for k, ws in INDUSTRY_KEYWORDS) + " END"
    dl = ("CASE " + " ".join(f"WHEN {_contains_any(t, ph)} THEN {v}" for ph, v in DELIVERY_PHRASES)
          + f" WHEN TRY_CAST({_grp(t, P_DELIVERY, 2)} AS INTEGER) IS NOT NULL"
          + f" THEN LEAST(GREATEST(TRY_CAST({_grp(t, P_DELIVERY, 2)} AS INTEGER) / 100.0, 0.0), 1.0) END")
    return f"""COALESCE({_money_sql(_grp(t, P_SALES_1M, 2))}, {_money_sql(_grp(t, P_SALES_ANY, 1))}) AS sales_1m,
  {_money_sql(_grp(t, P_SALES_3M, 2))} AS sales_3m_avg,
  TRY_CAST({_grp(t, P_CUST_1M, 2)} AS DOUBLE) AS cust_1m, TRY_CAST({_grp(t, P_CUST_3M, 2)} AS DOUBLE) AS cust_3m_avg,
  {ind} AS industry_code, {_grp(t, P_REGION, 1)} AS region_code, {dl} AS delivery_share"""


_UTT_SQL = f"""{REQUEST_SQL},
utt AS (SELECT store_id AS session_id, target_month, CASE
  WHEN (CAST(substr(target_month, 1, 4) AS INTEGER) * 12 + CAST(substr(target_month, 6, 2) AS INTEGER)) % 3 = 0 THEN
    industry_code || '집 ' || region_code || '에서 지난달 매출 ' || CAST(CAST(ROUND(sales_1m / 10000) AS BIGINT) AS VARCHAR)
    || '만원, 최근 3개월 평균 ' || CAST(CAST(ROUND(sales_3m_avg / 10000) AS BIGINT) AS VARCHAR) || '만원, ' || dv
  WHEN (CAST(substr(target_month, 1, 4) AS INTEGER) * 12 + CAST(substr(target_month, 6, 2) AS INTEGER)) % 3 = 1 THEN
    region_code || ' ' || industry_code || ' 가게, 지난달 고객 ' || CAST(CAST(cust_1m AS BIGINT) AS VARCHAR) || '명, 매출 '
    || CAST(CAST(ROUND(sales_1m / 10000) AS BIGINT) AS VARCHAR) || '만원'
  ELSE '한 달 ' || CAST(CAST(ROUND(sales_1m / 10000) AS BIGINT) AS VARCHAR) || '만원 벌었어요. ' || dv END AS message
  FROM (SELECT *, CASE WHEN delivery_share >= 0.6 THEN '배달 위주' WHEN delivery_share < 0.2 THEN '홀 위주'
    ELSE '배달 ' || CAST(CAST(ROUND(delivery_share * 100) AS BIGINT) AS VARCHAR) || '%' END AS dv FROM req))"""


def _utterances(spark, sf):
    return utterance_table(request_table(panel(spark, sf)))


@register("parse_money", f"""WITH {panel_ctes()}, {_UTT_SQL},
lst AS (SELECT session_id, target_month, regexp_extract_all(message, '[0-9][0-9,.]*\\s*(원|만원|천만원|억원)', 0) AS t FROM utt),
tok AS (SELECT session_id, target_month, unnest(range(len(t)))::INTEGER AS pos, unnest(t) AS token FROM lst)
SELECT session_id, target_month, pos, token, {_money_sql('token')} AS won FROM tok""")
def q_parse_money(spark, sf):
    """Every amount of every message, in order of appearance."""
    u = _utterances(spark, sf)
    tok = F.regexp_extract_all("message", F.lit(r"(?U)[0-9][0-9,.]*\s*(원|만원|천만원|억원)"), F.lit(0))
    d = u.select("session_id", "target_month", F.posexplode(tok).alias("pos", "token"))
    return d.withColumn("won", money_value(F.col("token")))


@register("parse_utterance", f"""WITH {panel_ctes()}, {_UTT_SQL}
SELECT session_id, target_month, message, {parse_sql('message')} FROM utt""")
def q_parse_utterance(spark, sf):
    return parse_messages(_utterances(spark, sf)).select("session_id", "target_month", "message", *SLOTS)


@register("parse_conversations", f"""SELECT conv_id, turn, {parse_sql('text')} FROM conversations WHERE role = 'user'""")
def q_parse_conversations(spark, sf):
    """The same parser over every user message of the conversation table (whole texts)."""
    c = Tables(spark, sf).conversations.where(F.col("role") == "user")
    return parse_messages(c, "text").select("conv_id", "turn", *SLOTS)


_DLG_SQL = f"""{REQUEST_SQL},
dlg AS (SELECT store_id || '/' || target_month AS session_id, unnest([0, 1, 2]) AS turn, unnest([
  industry_code || '집 ' || region_code || '에서 지난달 매출 ' || CAST(CAST(ROUND(sales_1m / 10000) AS BIGINT) AS VARCHAR) || '만원',
  '최근 3개월 평균 매출 ' || CAST(CAST(ROUND(sales_3m_avg / 10000) AS BIGINT) AS VARCHAR) || '만원',
  '아 지난달 매출 ' || CAST(CAST(ROUND(sales_1m * 1.1 / 10000) AS BIGINT) AS VARCHAR) || '만원으로 정정할게요'])
  AS message FROM req),
pdm AS (SELECT session_id, turn, message, {parse_sql('message')} FROM dlg),
pd AS (SELECT * EXCLUDE (message) FROM pdm),
st AS (SELECT session_id, turn,
  {', '.join(f"last({s} IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {s}" for s in SLOTS)}
  FROM pd)"""


def _state(spark, sf):
    return fill_slots(parse_messages(dialogue_table(request_table(panel(spark, sf)))))


@register("slot_fill", f"""WITH {panel_ctes()}, {_DLG_SQL}
SELECT session_id, turn, {', '.join(SLOTS)} FROM st""")
def q_slot_fill(spark, sf):
    return _state(spark, sf).select("session_id", "turn", *SLOTS)


def _missing_sql() -> str:
    items = ", ".join(f"CASE WHEN {s} IS NULL THEN '{s}' END" for s in REQUIRED_SLOTS)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def _questions_sql(missing: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FOLLOW_UP_QUESTIONS.items())
    return f"list_transform(list_slice({missing}, 1, 3), lambda x: CASE x {cases} ELSE x END)"


@register("missing_slots", f"""WITH {panel_ctes()}, {_DLG_SQL},
ms AS (SELECT session_id, turn, {_missing_sql()} AS missing FROM st)
SELECT session_id, turn, array_to_string(missing, ',') AS missing, array_to_string({_questions_sql('missing')}, ' / ')
  AS questions FROM ms""")
def q_missing_slots(spark, sf):
    d = missing_slots(_state(spark, sf))
    return d.select("session_id", "turn", F.concat_ws(",", "missing").alias("missing"),
                    F.concat_ws(" / ", "questions").alias("questions"))


def _pct_sql(e: str) -> str:
    """'%.1f%%' of 100 * e, rounded half-up on the shortest decimal form first (as the Spark side does)."""
    return f"printf('%.1f%%', CAST(ROUND(CAST(CAST(({e}) * 100.0 AS VARCHAR) AS DECIMAL(38, 18)), 1) AS DOUBLE))"


def _bullets_sql(lst: str, n: int) -> str:
    return f"array_to_string(list_transform(list_slice({lst}, 1, {n}), lambda x: '• ' || x), chr(10))"


def _reply_sql() -> str:
    from storewatch.plans.q_requests import expl_list_sql, qs_ctes, rec_list_sql
    emoji = "CASE alert " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALERT_EMOJI.items()) + " ELSE '⚪' END"
    nl = "chr(10)"
    text = (f"{emoji} || ' **위험도: ' || {_pct_sql('p_final')} || '** (경보: ' || alert || ')' || {nl} || {nl} "
            f"|| '📊 세부 위험도:' || {nl} || '- 매출: ' || {_pct_sql('Sales_Risk')} || {nl} || '- 고객: ' "
            f"|| {_pct_sql('Customer_Risk')} || {nl} || '- 시장: ' || {_pct_sql('Market_Risk')} || {nl} || {nl} "
            f"|| '💡 주요 인사이트:' || {nl} || {_bullets_sql('ex', 3)} || {nl} || {nl} || '🎯 개선 제안:' || {nl} "
            f"|| {_bullets_sql('rc', 2)}")
    return f"""WITH {panel_ctes()}, {_DLG_SQL},
ms AS (SELECT *, {_missing_sql()} AS missing FROM st),
ms2 AS (SELECT *, {_questions_sql('missing')} AS questions FROM ms),
{qs_ctes('ms2')},
rp AS (SELECT *, {expl_list_sql()} AS ex FROM rq),
rp2 AS (SELECT *, {rec_list_sql()} AS rc FROM rp)
SELECT session_id, turn, len(missing) > 0 AS needs_more_info,
  CASE WHEN len(missing) > 0 THEN '정보를 더 알려주세요: ' || array_to_string(questions, ', ') ELSE trim({text}) END AS reply
FROM rp2"""


@register("chat_reply", _reply_sql())
def q_chat_reply(spark, sf):
    """Reply text per dialogue turn (asks for missing slots, or the scored summary)."""
    d = chat_reply(_state(spark, sf))
    return d.select("session_id", "turn", "needs_more_info", "reply")
