"""Input cleaning and the usage/customer/merchant join."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.constants import BIN_COLS, KEY_MCT, KEY_YM
from storewatch.functions.bins import with_bin_rank_lenient
from storewatch.functions import sqlx as S
from storewatch.functions.months import month_lenient


def _month_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.typeName()


def coerce_keys(df: DataFrame) -> DataFrame:
    """Store key to string, month to the first day of its month (lenient parse, bad -> NULL)."""
    out = {}
    if KEY_MCT in df.columns:
        out[KEY_MCT] = F.col(KEY_MCT).cast("string")
    if KEY_YM in df.columns:
        out[KEY_YM] = month_lenient(KEY_YM, _month_type(df, KEY_YM))
    return df.withColumns(out) if out else df


def clean_values(df: DataFrame, keep: tuple = ()) -> DataFrame:
    """B1 on every non-key column (except ``keep``): to number, sentinel/NaN -> NULL."""
    skip = {KEY_MCT, KEY_YM, *keep}
    return df.withColumns({c: F.expr(S.safe_null(S.q(c))) for c in df.columns if c not in skip})


def _key_columns(df: DataFrame) -> list:
    return [c for c in (KEY_MCT, KEY_YM) if c in df.columns]


def unique_keys(df: DataFrame) -> DataFrame:
    """One row per key of a table whose keys are coerced: rows without a store key are rejected (they would all
    share one window), rows that repeat a key are reduced to the smallest one, so joins never multiply.
    Keyed by (store, month), or by store alone when there is no month; see :func:`key_report`.

    Whether any key repeats is asked first, of the key columns alone (counts are combined before the shuffle): a table without
    repeats, which is the rule, goes on as it is, without its whole rows being sorted and reduced."""
    keys = _key_columns(df)
    rest = [c for c in df.columns if c not in keys]
    known = df.where(F.col(KEY_MCT).isNotNull())
    if known.groupBy(*keys).count().where("count > 1").isEmpty():
        return known
    if not rest:
        return known.dropDuplicates(keys)
    one = known.groupBy(*keys).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_row"))
    return one.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def key_report(tables: dict) -> DataFrame:
    """Per input table: rows, rows without a store key, rows without a readable month (0 when the table has no
    month column), keys that occur more than once and the surplus rows that :func:`unique_keys` drops."""
    parts = []
    for name, df in tables.items():
        d = coerce_keys(df)
        keys = _key_columns(d)
        per = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        known = F.col(KEY_MCT).isNotNull()
        month = F.sum(F.when(F.col(KEY_YM).isNull(), F.col("n")).otherwise(0)) if KEY_YM in keys else F.lit(0)
        parts.append(per.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("no_store"),
            F.coalesce(month, F.lit(0)).cast("long").alias("no_month"),
            F.count(F.when(known & (F.col("n") > 1), 1)).alias("repeated_keys"),
            F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("surplus_rows"),
        ).select(F.lit(name).alias("input"), "*"))
    return reduce(DataFrame.unionByName, parts)


def load_and_join(ds1: DataFrame, ds2: DataFrame, ds3: DataFrame, bins_after_clean: bool = False) -> DataFrame:
    """usage LEFT JOIN customers on (store, month) LEFT JOIN merchants on store, each reduced to unique keys first.

    Bin label columns are kept as strings (``bins_after_clean=True`` cleans them too, which turns every
    bin into a missing value as the original flow does). Columns repeated in customers get ``_C``; merchant
    columns that clash with usage columns get ``_M`` (the usage value keeps the plain name).
    """
    keep = () if bins_after_clean else tuple(BIN_COLS)
    usage = unique_keys(clean_values(coerce_keys(ds2), keep))
    cust = unique_keys(clean_values(coerce_keys(ds3)))
    cust = cust.select(*[F.col(c).alias(c + "_C") if c in usage.columns and c not in (KEY_MCT, KEY_YM) else F.col(c)
                         for c in cust.columns])
    merch = unique_keys(ds1.withColumn(KEY_MCT, F.col(KEY_MCT).cast("string")))
    taken = set(usage.columns) | set(cust.columns)
    merch = merch.select(*[F.col(c).alias(c + "_M") if c in taken and c != KEY_MCT else F.col(c)
                           for c in merch.columns])
    return usage.join(cust, [KEY_MCT, KEY_YM], "left").join(merch, [KEY_MCT], "left")


def normalize_bins(df: DataFrame, lenient: bool = False) -> DataFrame:
    """Six bin columns -> ``<col>_RANK``; missing or unknown -> 0.5, absent column -> 0.5."""
    present = [c for c in BIN_COLS if c in df.columns]
    if lenient:
        df = with_bin_rank_lenient(df, {f"{c}_RANK": c for c in present})
        ranks = {f"{c}_RANK": F.coalesce(F.col(f"{c}_RANK"), F.lit(0.5)) for c in present}
    else:
        ranks = {f"{c}_RANK": F.expr(f"coalesce({S.bin_rank(S.q(c))}, 0.5D)") for c in present}
    ranks.update({f"{c}_RANK": F.lit(0.5) for c in BIN_COLS if c not in present})
    return df.withColumns(ranks)
