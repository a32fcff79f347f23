"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus the matching DuckDB oracle SQL.

Each query reads the input tables (or what Spark derives from them) in full. Doubles are rounded to six
digits in both the Spark result and the SQL so that the value hashes compare engines, not last bits.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storewatch.sources.panel import Panel, build_panel

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_PANELS: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def panel(spark: SparkSession, sf_dir: str, cancel_form: str = "bin") -> Panel:
    """Derived tables, built once per session and input folder (the store-month table is checkpointed)."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _PANELS:
        _PANELS[key] = build_panel(spark, sf_dir)
    return _PANELS[key].with_cancel(cancel_form)


def scored(spark: SparkSession, sf_dir: str, with_preds: bool = True) -> DataFrame:
    """The risk output table (pipeline with model predictions), built once per session and folder."""
    from storewatch.plans.pipeline import run_pipeline
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, "scored", with_preds)
    if key not in _PANELS:
        p = panel(spark, sf_dir)
        from storewatch.session import cut_lineage
        _PANELS[key] = cut_lineage(
            run_pipeline(p.merchants, p.usage, p.customers, preds=p.preds if with_preds else None))
    return _PANELS[key]


def reset_cache() -> None:
    _PANELS.clear()


def drop_scored() -> None:
    """Forget cached risk outputs (keep the derived input tables)."""
    for k in [k for k in _PANELS if "scored" in k]:
        del _PANELS[k]


def r6(*cols: str) -> list:
    return [F.round(F.col(c), 6).alias(c) for c in cols]
