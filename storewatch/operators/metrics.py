"""Exact ranking metrics (ROC-AUC with averaged ties, average precision) and median imputation.

Both metrics need running sums over the score order. They run on one row per distinct score through
:func:`storewatch.operators.ranking.value_ranks`, so no score order is ever gathered in one task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.operators.ranking import group_quantiles, value_ranks


def _pos_neg(df: DataFrame, score: str, label: str, group_cols: Sequence[str]) -> DataFrame:
    y = F.col(label).cast("double")
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *group_cols, F.col(score).cast("double").alias("_s"), y.alias("_pos"), (F.lit(1.0) - y).alias("_neg"))


def roc_auc(df: DataFrame, score: str, label: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """AUC = sum over distinct scores of pos * (neg below + neg tied / 2) / (P * N); NULL (with a note)
    when a class is missing."""
    vr = value_ranks(_pos_neg(df, score, label, group_cols), group_cols, "_s", ["_pos", "_neg"])
    contrib = F.col("_pos") * (F.col("cum__neg") - F.col("_neg") * F.lit(0.5))
    g = list(group_cols)
    agg = (vr.groupBy(*g) if g else vr).agg(
        F.sum(contrib).alias("_u"), F.max("tot__pos").alias("n_pos"), F.max("tot__neg").alias("n_neg"))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return agg.select(*g, F.when(ok, F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"),
                      F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
                      F.when(ok, F.lit(None).cast("string")).otherwise(F.lit("single-class")).alias("note"))


def average_precision(df: DataFrame, score: str, label: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """AP = sum over distinct thresholds (high to low) of (pos at t / P) * precision(>= t)."""
    d = _pos_neg(df, score, label, group_cols).withColumn("_s", -F.col("_s"))
    vr = value_ranks(d, group_cols, "_s", ["_pos"])
    prec = F.col("cum__pos") / (F.col("lt") + F.col("n"))
    g = list(group_cols)
    agg = (vr.groupBy(*g) if g else vr).agg(F.sum(F.col("_pos") * prec).alias("_a"),
                                           F.max("tot__pos").alias("n_pos"), F.max("tot").alias("n"))
    ok = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return agg.select(*g, F.when(ok, F.col("_a") / F.col("n_pos")).alias("avg_precision"),
                      F.col("n_pos").cast("long").alias("n_pos"), F.col("n").alias("n"))


def fit_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact median of every column in one distributed pass: (feature, median)."""
    from functools import reduce
    stacked = reduce(DataFrame.unionByName, [
        df.select(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])
    return group_quantiles(stacked, ["feature"], "v", [0.5], names=["median"])


def impute_medians(df: DataFrame, medians: DataFrame, cols: Sequence[str]) -> DataFrame:
    """coalesce(x, fitted median): the fitted table (one row per feature) travels as one scalar struct."""
    fitted = medians.agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"m{i}") for i, c in enumerate(cols)])
    row = fitted.select(F.struct(*fitted.columns).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), row.getField(f"m{i}")) for i, c in enumerate(cols)})
