"""Utterance parsing as column expressions: money amounts, customer counts, industry, region, delivery.

Java regex ``\\d``/``\\s`` are ASCII by default; ``(?U)`` makes them Unicode like Python's."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from storewatch.constants import DELIVERY_PHRASES, INDUSTRY_KEYWORDS, MONEY_UNITS
from storewatch.functions.core import _c

# fixed patterns of the utterance rules
UNIT = "(원|만원|천만원|억원)"
P_SALES_1M = r"(?U)(한\s*달|지난달|최근\s*1개월)[^\d]*(\d[\d,\.]*\s*" + UNIT + ")"
P_SALES_3M = r"(?U)(3개월|최근\s*세\s*달|최근\s*3개월)[^\d]*(\d[\d,\.]*\s*" + UNIT + ")"
P_CUST_1M = r"(?U)(지난달|최근\s*1개월)[^\d]*(\d{1,6})\s*명"
P_CUST_3M = r"(?U)(3개월|최근\s*세\s*달|최근\s*3개월)[^\d]*(\d{1,6})\s*명"
P_SALES_ANY = r"(?U)매출[^\d]*(\d[\d,\.]*\s*" + UNIT + ")"
P_REGION = r"([가-힣A-Za-z0-9]+(구|동|시|군|읍|면))"
P_DELIVERY = r"(?U)(배달|딜리버리)[^\d]*(\d{1,3})\s*%"
P_AMOUNT = r"(?U)^([0-9]+(?:\.[0-9]+)?)\s*" + UNIT + "?"


def _nz(s: Column) -> Column:
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def money_value(text) -> Column:
    """'1.5천만원' -> 15000000.0: number times the unit (won by default); NULL if no leading number."""
    t = F.trim(F.replace(_c(text), F.lit(","), F.lit("")))
    num = _nz(F.regexp_extract(t, P_AMOUNT, 1)).try_cast("double")
    unit = F.coalesce(_nz(F.regexp_extract(t, P_AMOUNT, 2)), F.lit("원"))
    mult = F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in MONEY_UNITS.items())), unit)
    return num * mult


def _money_after(text: Column, pattern: str, group: int) -> Column:
    return money_value(_nz(F.regexp_extract(text, pattern, group)))


def industry_of(text) -> Column:
    """First industry (in dictionary order) whose keyword occurs in the text."""
    t = _c(text)
    expr = None
    for industry, words in INDUSTRY_KEYWORDS:
        cond = None
        for w in words:
            c = F.contains(t, F.lit(w))
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(industry)) if expr is None else expr.when(cond, F.lit(industry))
    return expr


def delivery_share_of(text) -> Column:
    t = _c(text)
    expr = None
    for phrases, value in DELIVERY_PHRASES:
        cond = None
        for ph in phrases:
            c = F.contains(t, F.lit(ph))
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    pct = _nz(F.regexp_extract(t, P_DELIVERY, 2)).try_cast("int")
    clipped = F.least(F.greatest(pct / F.lit(100.0), F.lit(0.0)), F.lit(1.0))
    return expr.when(pct.isNotNull(), clipped)   # no mention -> missing


def parse_utterance_cols(text) -> dict:
    """Slot name -> expression; a slot the text does not mention is NULL."""
    t = F.trim(_c(text))
    s1 = _money_after(t, P_SALES_1M, 2)
    return {
        "sales_1m": F.coalesce(s1, _money_after(t, P_SALES_ANY, 1)),
        "sales_3m_avg": _money_after(t, P_SALES_3M, 2),
        "cust_1m": _nz(F.regexp_extract(t, P_CUST_1M, 2)).try_cast("double"),
        "cust_3m_avg": _nz(F.regexp_extract(t, P_CUST_3M, 2)).try_cast("double"),
        "industry_code": industry_of(t),
        "region_code": _nz(F.regexp_extract(t, P_REGION, 1)),
        "delivery_share": delivery_share_of(t),
    }
