"""Month keys: strict and lenient parsing, month end horizons."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storewatch.functions.core import _c

LENIENT_FORMATS = ("yyyyMM", "yyyy-MM", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyy.MM")


def month_strict(x) -> Column:
    """``yyyyMM`` only; a bad value raises under ANSI mode."""
    return F.trunc(F.to_date(_c(x).cast("string"), "yyyyMM"), "MM")


def month_lenient(x, input_type: str = "string") -> Column:
    """Any supported date spelling -> first day of month; unparseable -> NULL."""
    c = _c(x)
    if input_type in ("date", "timestamp", "timestamp_ntz"):
        return F.trunc(c.cast("date"), "MM")
    s = F.trim(c.cast("string"))
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in LENIENT_FORMATS])
    return F.trunc(parsed.cast("date"), "MM")


def horizon_end(month, k: int) -> Column:
    """Month end of ``month`` plus ``k`` months (clamped to the month's last valid day)."""
    return F.add_months(F.last_day(_c(month)), k)


def yyyymm(month) -> Column:
    return F.date_format(_c(month), "yyyyMM")
