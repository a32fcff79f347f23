"""Golden request and utterances from the service documentation, dialogue slot filling."""
import pytest
from pyspark.sql import functions as F

from storewatch.functions.text import money_value, parse_utterance_cols
from storewatch.operators.dialogue import chat_reply, fill_slots, parse_messages
from storewatch.operators.quickscore import quickscore

REQ = "store_id string, target_month string, region_code string, industry_code string, delivery_share double, " \
      "sales_1m double, sales_3m_avg double, cust_1m double, cust_3m_avg double"


def test_quickscore_golden(spark):
    df = spark.createDataFrame([(None, None, "강남구", "치킨", 0.7, 15000000.0, 18000000.0, 450.0, 500.0)], REQ)
    r = quickscore(df).first()
    assert (r.Sales_Risk, r.Customer_Risk, r.Market_Risk, r.risk_score) == (0.016667, 0.01, 0.566, 0.179467)
    assert r.alert == "GREEN" and r.explanations == ["지역/업종 시장 위험도 상회"]
    assert len(r.recommendations) == 2


def test_quickscore_zero_counts_as_missing(spark):
    df = spark.createDataFrame([(None, None, None, None, None, 0.0, 100.0, None, None)], REQ)
    r = quickscore(df).first()
    assert r.Sales_Risk == 0.0 and r.Market_Risk == 0.55 and r.p_final <= 0.265


@pytest.mark.parametrize("text,exp", [
    ("강남구에서 치킨집 하는데 지난달 매출 1500만원이야", {"industry_code": "치킨", "region_code": "강남구", "sales_1m": 1.5e7,
                                              "sales_3m_avg": None}),
    ("강남구 치킨집인데 배달 위주고 한 달 매출 1500만원, 고객 450명", {"industry_code": "치킨", "region_code": "강남구",
                                                    "delivery_share": 0.8, "sales_1m": 1.5e7, "cust_1m": None}),
    ("카페 운영, 최근 3개월 평균 매출 1.5천만원, 배달 30%", {"industry_code": "카페", "sales_3m_avg": 1.5e7,
                                             "delivery_share": 0.3}),
])
def test_parse_utterance_golden(spark, text, exp):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(*[c.alias(k) for k, c in parse_utterance_cols(F.col("t")).items()]).first().asDict()
    for k, v in exp.items():
        assert r[k] == v, (k, r)


def test_money_units(spark):
    df = spark.createDataFrame([("1,500만원",), ("2억원",), ("700",), ("x",)], "t string")
    assert [r.v for r in df.select(money_value("t").alias("v")).collect()] == [1.5e7, 2e8, 700.0, None]


def test_dialogue_slots_and_reply(spark):
    turns = [("s1", 0, "치킨집 강남구에서 지난달 매출 1500만원"), ("s1", 1, "최근 3개월 평균 매출 1800만원"),
             ("s1", 2, "아 지난달 매출 1600만원으로 정정할게요")]
    df = spark.createDataFrame(turns, "session_id string, turn int, message string")
    st = {r.turn: r for r in chat_reply(fill_slots(parse_messages(df))).collect()}
    assert st[0].needs_more_info and st[0].missing == ["sales_3m_avg"]
    assert st[1].sales_3m_avg == 1.8e7 and not st[1].needs_more_info
    assert st[2].sales_1m == 1.6e7 and st[2].industry_code == "치킨"
    assert "경보: GREEN" in st[2].reply
