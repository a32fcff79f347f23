"""Training labels (closure, proxy, top-q, n-largest), their cascade, class weights and the split."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.constants import CLOSE_DATE, KEY_MCT, KEY_YM
from storewatch.functions.months import horizon_end
from storewatch.operators.prepare import coerce_keys, unique_keys
from storewatch.operators.ranking import global_quantiles, value_ranks
from storewatch.operators.reports import top_k
from storewatch.operators.windows import store_window
from storewatch.session import cut_lineage


def label_base(ds2: DataFrame, ds3: DataFrame) -> DataFrame:
    """usage FULL OUTER JOIN customers on (store, month); keys coalesced, months parsed."""
    return unique_keys(coerce_keys(ds2)).join(unique_keys(coerce_keys(ds3)), [KEY_MCT, KEY_YM], "full")


def closure_label(base: DataFrame, ds1: DataFrame, k_months: int = 3) -> DataFrame:
    """y = 1 when the store's close date falls after the month and within month end + k months."""
    close = unique_keys(ds1.select(F.col(KEY_MCT).cast("string").alias(KEY_MCT),
                                   F.col(CLOSE_DATE).cast("date").alias(CLOSE_DATE)))
    d = base.join(close, KEY_MCT, "left")
    me, t0 = F.col(CLOSE_DATE), F.col(KEY_YM)
    cond = me.isNotNull() & (me > t0) & (me <= horizon_end(t0, k_months))
    return d.withColumn("y", F.when(cond, F.lit(1)).otherwise(F.lit(0)))


def _first_int(col: str) -> F.Column:
    raw = F.regexp_extract(F.col(col).cast("string"), r"(\d+)", 1)
    return F.when(raw == "", F.lit(None).cast("double")).otherwise(raw.try_cast("double"))


def proxy_signals(base: DataFrame) -> DataFrame:
    """Rank drops of sales / customers (first integer of the bin label, diff per store), cancel share and
    the industry / area closure shares."""
    w = store_window()
    d = base.withColumns({"_saa": _first_int("RC_M1_SAA"), "_cus": _first_int("RC_M1_UE_CUS_CN")})
    return d.withColumns({
        "dSAA": F.col("_saa") - F.lag("_saa", 1).over(w),
        "dCUS": F.col("_cus") - F.lag("_cus", 1).over(w),
        "cxl": F.col("APV_CE_RAT").try_cast("double") if "APV_CE_RAT" in d.columns else F.lit(0.0),
        "indme": F.col("M12_SME_RY_ME_MCT_RAT").try_cast("double") if "M12_SME_RY_ME_MCT_RAT" in d.columns else F.lit(0.0),
        "bznme": F.col("M12_SME_BZN_ME_MCT_RAT").try_cast("double") if "M12_SME_BZN_ME_MCT_RAT" in d.columns else F.lit(0.0),
    }).drop("_saa", "_cus")


def _flag(cond: F.Column) -> F.Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def proxy_label(base: DataFrame) -> DataFrame:
    """2-of-5 rule: drops <= -10, cancel >= 90, industry / area closure >= 80."""
    d = proxy_signals(base)
    sig = (_flag(F.col("dSAA") <= -10) + _flag(F.col("dCUS") <= -10) + _flag(F.col("cxl") >= 90)
           + _flag(F.col("indme") >= 80) + _flag(F.col("bznme") >= 80))
    return d.withColumn("sig", sig).withColumn("y", (F.col("sig") >= 2).cast("int"))


def proxy_label_any(base: DataFrame) -> DataFrame:
    """Any-of rule: drops <= -10, cancel >= 90, industry / area closure >= 90."""
    d = proxy_signals(base)
    bad = ((F.col("dSAA") <= -10) | (F.col("dCUS") <= -10) | (F.col("cxl") >= 90) | (F.col("indme") >= 90)
           | (F.col("bznme") >= 90))
    return d.withColumn("y", _flag(bad))


def topq_label(keys: DataFrame, scores: DataFrame, topq: float = 0.10) -> DataFrame:
    """Label keys by p_final >= its (1 - topq) quantile over the label keys; unmatched score -> 0."""
    d = scores.select(KEY_MCT, KEY_YM, "p_final").join(keys.select(KEY_MCT, KEY_YM), [KEY_MCT, KEY_YM], "right")
    d = d.withColumn("pf", F.coalesce(F.col("p_final"), F.lit(0.0)))
    (thr,) = global_quantiles(d, "pf", [1.0 - topq])
    return d.withColumn("thr", thr).withColumn("y", (F.col("pf") >= F.col("thr")).cast("int"))


def nlargest_label(scores: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` highest p_final rows (ties by key) are positive. The flagged set has at most ``n`` rows."""
    top = top_k(scores, "p_final", n).select(KEY_MCT, KEY_YM, F.lit(1).alias("_top"))
    return (scores.join(F.broadcast(top), [KEY_MCT, KEY_YM], "left")
            .withColumn("y", F.coalesce(F.col("_top"), F.lit(0))).drop("_top"))


def class_summary(labeled: DataFrame, y: str = "y") -> DataFrame:
    """Count, share and "balanced" weight n / (2 * n_c) per class."""
    per = labeled.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    total = labeled.select(F.count(F.lit(1))).scalar()
    return per.select(y, "n", (F.col("n") / total).alias("share"), (total / (F.lit(2.0) * F.col("n"))).alias("weight"))


def n_classes(labeled: DataFrame, y: str = "y") -> int:
    """One small aggregate action (the cascade's decision point)."""
    return int(labeled.agg(F.countDistinct(y)).first()[0])


def _candidate(labeled: DataFrame, source: str) -> DataFrame:
    """Keys and label of one of the cascade's sources, written once: what is asked of it and what is returned read the narrow table."""
    return cut_lineage(labeled.select(KEY_MCT, KEY_YM, "y")).withColumn("source", F.lit(source))


def label_cascade(base_bin: DataFrame, base_num: DataFrame, ds1: DataFrame, scores: DataFrame,
                  k_months: int = 3, topq: float = 0.10) -> DataFrame:
    """closure -> 2-of-5 proxy -> top-q -> n-largest, switching while only one class is present."""
    lab = _candidate(closure_label(base_bin, ds1, k_months), "closure")
    if n_classes(lab) >= 2:
        return lab
    px = _candidate(proxy_label(base_num), "proxy")
    if n_classes(px) >= 2 and px.agg(F.sum("y")).first()[0] > 0:
        return px
    tq = _candidate(topq_label(lab, scores, topq), "topq")
    if n_classes(tq) >= 2:
        return tq
    return nlargest_label(scores).select(KEY_MCT, KEY_YM, "y").withColumn("source", F.lit("nlargest"))


def stratified_split(labeled: DataFrame, test_size: float = 0.25, seed: int = 42, y: str = "y") -> DataFrame:
    """Per class, the ``max(1, round_half_even(test_size * n_c))`` rows with the smallest
    md5(store|month|seed) go to test. If a class has fewer than 2 rows, train = test = all rows.
    Ranks within a class come from :func:`value_ranks` (a class can be most of the table). The labels are written once: ranks, counts
    and the final join read that table, not the joins behind it."""
    labeled = cut_lineage(labeled)
    key = F.md5(F.concat_ws("|", F.col(KEY_MCT), F.date_format(KEY_YM, "yyyy-MM-dd"), F.lit(str(seed))))
    d = labeled.withColumn("_h", key)
    vr = value_ranks(d, [y], "_h").select(y, "_h", "lt", "tot")
    counts = d.groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.agg(F.min("_n").alias("least"), F.count(F.lit(1)).alias("classes")).first()
    small = sizes.classes < 2 or sizes.least < 2
    out = d.join(vr, [y, "_h"], "left")
    if small:
        return out.withColumns({"is_test": F.lit(1), "is_train": F.lit(1)}).drop("_h", "lt", "tot")
    t = F.greatest(F.lit(1), F.bround(F.col("tot") * F.lit(test_size), 0).cast("long"))
    return (out.withColumn("is_test", (F.col("lt") < t).cast("int"))
            .withColumn("is_train", 1 - F.col("is_test")).drop("_h", "lt", "tot"))
