"""Rules of the request shapes: every rule that a row breaks, by name; rows are never dropped."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewatch.operators.lookup import MAX_LIMIT

MONTH = r"^[0-9]{4}-(0[1-9]|1[0-2])$"
CHANNELS = ["email", "sms", "webhook"]   # fixed values


def with_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``df`` with ``reasons`` (names of the rules that do not hold; an unknown outcome counts as broken) and ``valid``."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])
    return df.withColumn("reasons", F.filter(broken, lambda x: x.isNotNull())).withColumn("valid", F.size("reasons") == 0)


def optional(col: str, ok: Column) -> Column:
    return F.col(col).isNull() | ok


def validate_feedback(df: DataFrame) -> DataFrame:
    """id and session_id are there, rating is 1 to 5."""
    return with_reasons(df, [("id", F.col("id").isNotNull()), ("session_id", F.col("session_id").isNotNull()), ("rating", F.col("rating").between(1, 5))])


def validate_configs(df: DataFrame) -> DataFrame:
    """Store given, thresholds within 0 to 1 (absent: the defaults hold), known channels only."""
    rules = [("store_id", F.col("store_id").isNotNull())]
    rules += [(c, optional(c, F.col(c).between(0.0, 1.0))) for c in ("yellow", "orange", "red")]
    known = F.forall(F.coalesce("channels", F.array().cast("array<string>")), lambda x: F.coalesce(x.isin(CHANNELS), F.lit(False)))
    return with_reasons(df, [*rules, ("channels", known)])


def validate_history_requests(df: DataFrame) -> DataFrame:
    """Months are yyyy-MM in order, limit is 1 to MAX_LIMIT."""
    month = lambda c: optional(c, F.col(c).rlike(MONTH))
    return with_reasons(df, [("start", month("start")), ("end", month("end")), ("limit", F.col("limit").between(1, MAX_LIMIT)),
                             ("period", F.col("start").isNull() | F.col("end").isNull() | (F.col("start") <= F.col("end")))])


def validate_forecast_requests(df: DataFrame) -> DataFrame:
    """Store given, 1 to 12 months ahead."""
    return with_reasons(df, [("store_id", F.col("store_id").isNotNull()), ("months_ahead", F.col("months_ahead").between(1, 12))])
