"""Null-safe scalar math as Column -> Column expressions (all JVM-side, codegen friendly).

Spark's ``greatest``/``least`` skip NULL, while the scoring rules propagate missing values,
so every clip below guards NULL explicitly. NaN is treated as missing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewatch.constants import LOGIT_CLIP, VERY_NEGATIVE_SV


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing(x) -> Column:
    x = _c(x)
    return x.isNull() | F.isnan(x)


def clip(x, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; missing stays missing (NaN is turned into NULL at ingest by ``safe_null``)."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(x.cast("double"), F.lit(float(lo))), F.lit(float(hi))))


def clip01(x) -> Column:
    """``nz``: clip to [0, 1], missing stays missing."""
    return clip(x, 0.0, 1.0)


def zero01(x) -> Column:
    """Missing -> 0, then clip to [0, 1]."""
    return F.coalesce(clip01(x), F.lit(0.0))


def relu_minus(x) -> Column:
    """max(0, -x); missing stays missing."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(-x.cast("double"), F.lit(0.0)) + F.lit(0.0))   # + 0.0 turns -0.0 into 0.0


def logistic(x) -> Column:
    """1 / (1 + exp(-x)); the exponent is capped so huge negative inputs give ~0 instead of overflow."""
    x = _c(x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(-x, F.lit(700.0))))


def to_percent(x) -> Column:
    """x / 100 clipped to [0, 1]; missing stays missing."""
    return clip01(_c(x) / F.lit(100.0))


def nanmax(a, b) -> Column:
    """Element-wise max that propagates missing values."""
    a, b = _c(a), _c(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(a, b))


def logit(p, eps: float = LOGIT_CLIP) -> Column:
    pc = clip(p, eps, 1.0 - eps)
    return F.log(pc / (F.lit(1.0) - pc))


def safe_null(x) -> Column:
    """To number (unparseable -> NULL); the missing sentinel (<= -9e5) and NaN -> NULL."""
    v = F.expr(f"try_cast({_sql(x)} as double)") if isinstance(x, str) else x.try_cast("double")
    return F.when(missing(v) | (v <= F.lit(VERY_NEGATIVE_SV)), F.lit(None).cast("double")).otherwise(v)


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col_or_default(df: DataFrame, name: str, default) -> Column:
    """The column if the frame has it, else a constant (absent optional inputs)."""
    if name in df.columns:
        return F.col(name).cast("double")
    return F.lit(default).cast("double") if default is not None else F.lit(None).cast("double")


def round6(x) -> Column:
    return F.round(_c(x), 6)
