"""Bin label -> rank expressions (table lookup and the lenient parser)."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from storewatch.constants import BIN2RANK
from storewatch.functions.core import _c


def _nan_to_null(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def _lookup(key: Column) -> Column:
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in BIN2RANK.items()))
    return F.element_at(m, key)


def _to_number(s: Column) -> Column:
    return _nan_to_null(s.try_cast("double"))


def bin_rank(x) -> Column:
    """Trim, exact label lookup, else the value as a number, else NULL."""
    s = F.trim(_c(x).cast("string"))
    return F.coalesce(_lookup(s), _to_number(s))


def lenient_norm(x) -> Column:
    """Spacing removed, '~' -> '-', '미만' -> '이하'."""
    s = F.trim(_c(x).cast("string"))
    return F.replace(F.replace(F.regexp_replace(s, r"\s", ""), F.lit("~"), F.lit("-")), F.lit("미만"), F.lit("이하"))


def with_bin_rank_lenient(df, specs: dict):
    """``out -> source column``: stages the normalised label as a column first so the parser's pieces
    reference it instead of repeating the normalisation (keeps generated code small)."""
    df = df.withColumns({f"_norm_{o}": lenient_norm(src) for o, src in specs.items()})
    df = df.withColumns({o: bin_rank_lenient(src, norm=F.col(f"_norm_{o}")) for o, src in specs.items()})
    return df.drop(*[f"_norm_{o}" for o in specs])


def bin_rank_lenient(x, norm: Column | None = None) -> Column:
    """Lenient parser: spacing/'~'/'미만' normalised, ranges 'a-b%' -> midpoint, 'n%초과' / 'n%이하' mapped
    into the top / bottom band, else the value as a number."""
    s = F.trim(_c(x).cast("string"))
    norm = lenient_norm(x) if norm is None else norm
    body = F.regexp_replace(norm, "%", "")
    lo = F.regexp_extract(body, r"(?U)^(\d{1,3})-?", 1).try_cast("double")
    hi_raw = F.regexp_extract(body, r"(?U)-(\d{1,3})$", 1)
    hi = F.when(hi_raw == "", F.lit(None).cast("double")).otherwise(hi_raw.try_cast("double"))
    is_range = norm.rlike(r"(?U)^\d{1,3}-?\d{1,3}%$")
    mid = F.least(F.greatest((lo + hi) / F.lit(200.0), F.lit(0.0)), F.lit(1.0))
    over_v = F.regexp_extract(norm, r"(?U)^(\d{1,3})%초과$", 1).try_cast("double") / F.lit(100.0)
    under_v = F.regexp_extract(norm, r"(?U)^(\d{1,3})%이하$", 1).try_cast("double") / F.lit(100.0)
    over = F.least(F.lit(0.95), F.greatest(F.lit(0.90), over_v + F.lit(0.05)))
    under = F.greatest(F.lit(0.05), F.least(F.lit(0.10), under_v - F.lit(0.05)))
    return F.coalesce(
        _lookup(norm),
        F.when(is_range & lo.isNotNull() & hi.isNotNull(), mid),
        F.when(norm.rlike(r"(?U)^\d{1,3}%초과$"), over),
        F.when(norm.rlike(r"(?U)^\d{1,3}%이하$"), under),
        _to_number(s),
    )
