"""Alert labels: quantile-within-group, absolute thresholds with persistence, and the service rule."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewatch.constants import AREA, INDUSTRY, KEY_MCT, KEY_YM, QUANTILE_CUTS, SERVICE_CUTS, THRESHOLDS
from storewatch.operators.ranking import global_quantiles, group_quantiles
from storewatch.operators.windows import rolling_mean, store_window

FALLBACK_GROUPS = [[INDUSTRY, AREA, KEY_YM], [INDUSTRY, KEY_YM], [AREA, KEY_YM], [KEY_YM], []]


def resolve_group_cols(columns: Sequence[str], requested: Sequence[str] | None) -> list:
    """Requested columns that exist; if none, the first fully present fallback set."""
    cols = [c for c in (requested or []) if c in columns]
    if cols:
        return cols
    for cand in FALLBACK_GROUPS:
        if all(c in columns for c in cand):
            return list(cand)
    return []


def label_by_cuts(score: Column, y: Column, o: Column, r: Column) -> Column:
    return (F.when(score >= r, "RED").when(score >= o, "ORANGE").when(score >= y, "YELLOW").otherwise("GREEN"))


def assign_alert_by_quantile(df: DataFrame, group_cols: Sequence[str] | None = None, score_col: str = "p_final",
                             cuts: Sequence[float] = QUANTILE_CUTS, out_col: str = "Alert") -> DataFrame:
    """RED >= q97, ORANGE >= q90, YELLOW >= q80 of the score within its group, else GREEN (ties go up).

    Thresholds come from :func:`group_quantiles` (exact, distributed); the per-group threshold table has
    one row per group and is joined back (AQE broadcasts it when small). Rows with a NULL group key get
    a NULL label."""
    if score_col not in df.columns:
        raise KeyError(f"score_col '{score_col}' not in DataFrame")
    cols = resolve_group_cols(df.columns, group_cols)
    if cols:
        q = group_quantiles(df, cols, score_col, cuts, names=["_qy", "_qo", "_qr"])
        joined = df.join(q, cols, "left")
    else:                     # no grouping: the three thresholds are scalar subqueries
        qy, qo, qr = global_quantiles(df, score_col, cuts)
        joined = df.withColumns({"_qy": qy, "_qo": qo, "_qr": qr})
    label = label_by_cuts(F.col(score_col), F.col("_qy"), F.col("_qo"), F.col("_qr"))
    null_group = None
    for c in cols:
        null_group = F.col(c).isNull() if null_group is None else (null_group | F.col(c).isNull())
    if null_group is not None:
        label = F.when(null_group, F.lit(None).cast("string")).otherwise(label)
    return joined.withColumn(out_col, label).drop("_qy", "_qo", "_qr")


def assign_alert_persistent(df: DataFrame, score_col: str = "p_final", out_col: str = "Alert",
                            store: str = KEY_MCT, month: str = KEY_YM) -> DataFrame:
    """Absolute thresholds; RED also needs the store's last-k mean >= red - delta."""
    t = THRESHOLDS
    w = store_window(store, month)
    p = F.col(score_col)
    pbar = rolling_mean(p, w, int(t["persistence_k"]))
    label = (F.when((p >= t["red"]) & (pbar >= t["red"] - t["delta"]), "RED")
             .when(p >= t["orange"], "ORANGE").when(p >= t["yellow"], "YELLOW").otherwise("GREEN"))
    return df.withColumn(out_col, label)


def service_alert(p_final: Column, cuts: Sequence[float] = SERVICE_CUTS) -> Column:
    """Three-level rule: RED >= .9, ORANGE >= .7, else GREEN."""
    orange, red = cuts
    return F.when(p_final >= red, "RED").when(p_final >= orange, "ORANGE").otherwise("GREEN")
