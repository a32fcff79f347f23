"""Reads with arguments over the scored table and the prediction history: per store, period, limit, thresholds.

Arguments are plain values, or a table with one row per store for many stores at once (joined, so a batch of
look-ups is one job)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storewatch.constants import KEY_MCT, KEY_YM

MAX_LIMIT = 1000


def store_timeline(df: DataFrame, store: str | None = None, start: str | None = None, end: str | None = None,
                   periods: DataFrame | None = None) -> DataFrame:
    """Rows of one store (or all), months ``start``..``end`` (first days, inclusive), in (store, month) order.

    ``periods``: table of store, start, end instead; a null bound is open, stores not listed are left out, a store listed
    several times has the rows of all its periods once."""
    d = df
    if periods is not None:
        p = periods.select(F.col(KEY_MCT).alias("_store"), F.col("start").alias("_start"), F.col("end").alias("_end"))
        inside = (F.coalesce(F.col(KEY_YM) >= F.col("_start"), F.col("_start").isNull())
                  & F.coalesce(F.col(KEY_YM) <= F.col("_end"), F.col("_end").isNull()))
        d = d.join(p, (F.col(KEY_MCT) == F.col("_store")) & inside, "left_semi")
    if store is not None:
        d = d.where(F.col(KEY_MCT) == store)
    if start is not None:
        d = d.where(F.col(KEY_YM) >= F.lit(start).cast("date"))
    if end is not None:
        d = d.where(F.col(KEY_YM) <= F.lit(end).cast("date"))
    return d.orderBy(KEY_MCT, KEY_YM)


def history(df: DataFrame, store_id: str | None = None, start: str | None = None, end: str | None = None,
            limit: int = 100) -> DataFrame:
    """Newest ``limit`` (1 to 1000) records per store within target months ``start``..``end``, with ``rn``, the number of
    matching records of the store (``total_count``) and whether there are more (``has_more``)."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    d = df
    for cond in (None if store_id is None else F.col("store_id") == store_id,
                 None if start is None else F.col("target_month") >= start,
                 None if end is None else F.col("target_month") <= end):
        d = d if cond is None else d.where(cond)
    newest = Window.partitionBy("store_id").orderBy(F.col("created_at").desc(), F.col("target_month").desc())
    # ``rn <= limit`` becomes a group limit before the shuffle; the counts are a separate partial aggregate
    records = d.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= limit)
    totals = d.groupBy("store_id").agg(F.count(F.lit(1)).alias("total_count"))
    return records.join(totals, "store_id").withColumn("has_more", F.col("total_count") > limit)


def apply_thresholds(scores: DataFrame, config: DataFrame, defaults: tuple = (0.20, 0.30, 0.40)) -> DataFrame:
    """Alert of every score by its store's thresholds where it has an enabled configuration, else by the defaults.

    ``config``: store, yellow, orange, red, enabled, channels (array).  A store configured several times has its newest
    configuration by ``updated_at`` (if the table has it; then the largest values).  ``channels`` is kept for alerts above GREEN of
    enabled stores and null otherwise."""
    order = [c for c in ("updated_at", "yellow", "orange", "red", "enabled", "channels") if c in config.columns]
    one = config.groupBy(KEY_MCT).agg(F.max_by(F.struct(*order), F.struct(*order)).alias("c")).select(KEY_MCT, "c.*")
    c = one.where("enabled").select(KEY_MCT, *[F.col(n).alias(f"_{n}") for n in ("yellow", "orange", "red", "channels")])
    p = F.col("p_final")
    y, o, r = (F.coalesce(f"_{n}", F.lit(v)) for n, v in zip(("yellow", "orange", "red"), defaults))
    d = scores.join(c, KEY_MCT, "left").withColumn(
        "alert", F.when(p >= r, "RED").when(p >= o, "ORANGE").when(p >= y, "YELLOW").otherwise("GREEN"))
    return d.withColumn("channels", F.when(F.col("alert") != "GREEN", F.col("_channels"))).drop("_yellow", "_orange", "_red", "_channels")
