"""The null-safe helpers of :mod:`storewatch.functions.core` as Spark SQL expression text.

Building a Column through the Python API costs one JVM round trip per node; the risk path composes
hundreds of clips, so the hot paths compose SQL text and hand it to ``F.expr`` once per column. The
expressions are the same as the Column versions (NULL guarded, doubles throughout).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewatch.constants import BIN2RANK, VERY_NEGATIVE_SV


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def lit(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def clip01(e: str) -> str:
    return f"(CASE WHEN ({e}) IS NULL THEN NULL ELSE least(greatest(CAST(({e}) AS DOUBLE), 0.0D), 1.0D) END)"


def zero01(e: str) -> str:
    return f"coalesce({clip01(e)}, 0.0D)"


def relu_minus(e: str) -> str:
    return f"(CASE WHEN ({e}) IS NULL THEN NULL ELSE greatest(-CAST(({e}) AS DOUBLE), 0.0D) + 0.0D END)"


def to_percent(e: str) -> str:
    return clip01(f"({e}) / 100.0D")


def nanmax(a: str, b: str) -> str:
    return f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL ELSE greatest({a}, {b}) END)"


def logistic(e: str) -> str:
    return f"(1.0D / (1.0D + exp(least(-({e}), 700.0D))))"


def safe_null(e: str) -> str:
    v = f"try_cast(({e}) AS DOUBLE)"
    return f"(CASE WHEN isnan({v}) OR {v} <= {lit(VERY_NEGATIVE_SV)} THEN NULL ELSE {v} END)"


def bin_rank(e: str) -> str:
    t = f"trim(CAST(({e}) AS STRING))"
    cases = " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in BIN2RANK.items())
    num = f"try_cast({t} AS DOUBLE)"
    return f"coalesce(CASE {t} {cases} END, CASE WHEN isnan({num}) THEN NULL ELSE {num} END)"


def col_or_default(df: DataFrame, name: str, default) -> str:
    if name in df.columns:
        return f"CAST({q(name)} AS DOUBLE)"
    return "CAST(NULL AS DOUBLE)" if default is None else lit(default)


def x(e: str) -> Column:
    return F.expr(e)
