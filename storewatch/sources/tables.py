"""Readers for the input tables and a size-checked broadcast helper."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    return spark.read.parquet(path)


class Tables:
    """Lazy accessor: ``Tables(spark, dir).lineitem`` -> DataFrame (column pruning happens at the scan)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast ``df`` only if it provably has at most ``max_rows`` rows (checked with a bounded count);
    otherwise return it unchanged so the planner/AQE keeps a shuffle join."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
