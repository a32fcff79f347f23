"""Per-store time windows: month-over-month, rolling median / MAD / robust z, rolling mean.

All windows are ROWS frames over one store's months (``partitionBy(store).orderBy(month)``): a partition
holds one store's history, bounded by the number of months, and every expression shares the same
WindowSpec so Catalyst plans a single exchange + sort for all of them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storewatch.constants import EPS, KEY_MCT, KEY_YM, MAD_SCALE, MIN_PERIODS, ROLL_WINDOW
from storewatch.functions.core import _c


def store_window(store: str = KEY_MCT, month: str = KEY_YM):
    return Window.partitionBy(store).orderBy(F.col(month).asc_nulls_last())


def trailing(w, k: int):
    return w.rowsBetween(-(k - 1), Window.currentRow)


def mom(x, w) -> Column:
    """x - previous row's x (NULL on the first row of the store)."""
    x = _c(x)
    return x - F.lag(x, 1).over(w)


def rolling_median(x, w, window: int = ROLL_WINDOW, min_periods: int = MIN_PERIODS) -> Column:
    """Median of the last ``window`` rows, NULL unless ``min_periods`` non-missing values exist.

    The frame's non-missing values are gathered with ``collect_list`` (all series share one frame
    processor) and sorted; the median interpolates the two middle values as ``percentile(x, 0.5)``."""
    x = _c(x)
    vals = F.sort_array(F.collect_list(x).over(trailing(w, window)))   # sort_array: native, codegen
    n = F.size(vals)
    lo = F.element_at(vals, F.floor((n - 1) / 2).cast("int") + 1)
    hi = F.element_at(vals, F.ceil((n - 1) / 2).cast("int") + 1)
    return F.when(n >= min_periods, F.lit(0.5) * lo + F.lit(0.5) * hi)


def _median_of_sorted(vals: Column, min_periods: int) -> Column:
    n = F.size(vals)
    lo = F.element_at(vals, F.floor((n - 1) / 2).cast("int") + 1)
    hi = F.element_at(vals, F.ceil((n - 1) / 2).cast("int") + 1)
    return F.when(n >= min_periods, F.lit(0.5) * lo + F.lit(0.5) * hi)


def with_rolling_medians(df: DataFrame, specs: dict, w, window: int = ROLL_WINDOW,
                         min_periods: int = MIN_PERIODS) -> DataFrame:
    """``out -> column``: rolling medians with each sorted frame staged as a column first, so it is
    built once per row (not once per reference)."""
    frame = trailing(w, window)
    df = df.withColumns({f"_srt_{o}": F.sort_array(F.collect_list(c).over(frame)) for o, c in specs.items()})
    df = df.withColumns({o: F.expr(_median_sql(f"_srt_{o}", min_periods)) for o in specs})
    return df.drop(*[f"_srt_{o}" for o in specs])


def _median_sql(sorted_col: str, min_periods: int) -> str:
    """Same as :func:`_median_of_sorted`, as one SQL expression."""
    v = f"`{sorted_col}`"
    lo = f"element_at({v}, CAST(floor((size({v}) - 1) / 2) AS INT) + 1)"
    hi = f"element_at({v}, CAST(ceil((size({v}) - 1) / 2) AS INT) + 1)"
    return f"CASE WHEN size({v}) >= {int(min_periods)} THEN 0.5D * {lo} + 0.5D * {hi} END"


def rolling_mean(x, w, k: int) -> Column:
    """Mean of the last ``k`` rows, at least one value."""
    return F.avg(_c(x)).over(trailing(w, k))


def with_robust_z(df: DataFrame, specs: dict, w, window: int = ROLL_WINDOW,
                  min_periods: int = MIN_PERIODS) -> DataFrame:
    """For every ``name -> value expression`` add ``{name}_x``, ``{name}_med``, ``{name}_mad`` and
    ``{name}_z`` = (x - med) / (1.4826 * median(|x - med|) + EPS), where each row's deviation uses that
    row's own rolling median. Two stacked Window nodes on one partitioning."""
    df = df.withColumns({f"{n}_x": e for n, e in specs.items()})
    df = with_rolling_medians(df, {f"{n}_med": F.col(f"{n}_x") for n in specs}, w, window, min_periods)
    df = df.withColumns({f"{n}_dev": F.expr(f"abs(`{n}_x` - `{n}_med`)") for n in specs})
    df = with_rolling_medians(df, {f"{n}_mad0": F.col(f"{n}_dev") for n in specs}, w, window, min_periods)
    df = df.withColumns({f"{n}_mad": F.expr(f"CAST({MAD_SCALE!r} AS DOUBLE) * `{n}_mad0`") for n in specs}).drop(
        *[f"{n}_mad0" for n in specs])
    return df.withColumns({f"{n}_z": F.expr(f"(`{n}_x` - `{n}_med`) / (`{n}_mad` + CAST({EPS!r} AS DOUBLE))")
                           for n in specs})


def _frames(values: np.ndarray, depth: np.ndarray, min_periods: int, window: int) -> np.ndarray:
    """Median of the last ``window`` rows of every row but the first ``window - 1``, missing (masked) unless ``min_periods`` values are not.
    ``depth``: how many of its predecessors belong to the row's group."""
    seen = np.lib.stride_tricks.sliding_window_view(values.data, window).copy()
    away = np.lib.stride_tricks.sliding_window_view(values.mask, window) | (np.arange(window - 1, -1, -1) > depth[:, None])
    seen[away] = np.nan
    seen.sort(axis=1)   # NaN last, as Spark sorts it; what is missing counts as none
    n = window - away.sum(axis=1)
    lo, hi = (np.take_along_axis(seen, np.maximum(i, 0)[:, None], 1)[:, 0] for i in ((n - 1) // 2, n // 2))
    return np.ma.MaskedArray(0.5 * lo + 0.5 * hi, mask=n < min_periods)


def with_robust_z_scores(df: DataFrame, specs: dict, partition: str, order: list, window: int = ROLL_WINDOW,
                         min_periods: int = MIN_PERIODS) -> DataFrame:
    """The ``{name}_x`` and ``{name}_z`` columns of :func:`with_robust_z`, by the same arithmetic, for many series at once: rows are dealt by
    ``partition`` and sorted by it and ``order`` in Spark, each task then runs through its batches and sorts the frames of a whole batch together
    in numpy.  What it keeps between batches is the last ``window - 1`` rows."""
    df = df.withColumns({f"{n}_x": e for n, e in specs.items()})
    dealt = df.repartition(partition).sortWithinPartitions(partition, *[F.col(c).asc_nulls_last() for c in order])
    at, cols, names = df.columns.index(partition), [df.columns.index(f"{n}_x") for n in specs], [f"{n}_z" for n in specs]
    back = window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = [], -1
        none = np.ma.MaskedArray(np.full(back, np.nan), mask=np.ones(back, bool))
        kept = [(none, none)] * len(cols)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            key = batch.column(at)
            code = np.asarray(key.dictionary_encode().indices.fill_null(-1))
            new = np.concatenate([[last != [key[0].as_py()]], code[1:] != code[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(rows), -1))
            place = np.where(begin < 0, place + 1 + np.arange(rows), np.arange(rows) - begin)   # of each row in its group
            depth, place, last = np.minimum(place, back), int(place[-1]), [key[rows - 1].as_py()]
            made = []
            for i, c in enumerate(cols):
                x = batch.column(c).cast(pa.float64())
                x = np.ma.MaskedArray(np.asarray(x.fill_null(np.nan)), mask=np.asarray(x.is_null()))
                med = _frames(_after(kept[i][0], x), depth, min_periods, window)
                dev = np.ma.MaskedArray(np.abs(x.data - med.data), mask=x.mask | med.mask)
                mad = _frames(_after(kept[i][1], dev), depth, min_periods, window)
                z = (x.data - med.data) / (MAD_SCALE * mad.data + EPS)
                made.append(pa.array(z, pa.float64(), mask=x.mask | med.mask | mad.mask))
                kept[i] = _after(kept[i][0], x)[-back:], _after(kept[i][1], dev)[-back:]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return dealt.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]]))


def _after(before: np.ma.MaskedArray, rows: np.ma.MaskedArray) -> np.ma.MaskedArray:
    return np.ma.MaskedArray(np.concatenate([before.data, rows.data]), mask=np.concatenate([before.mask, rows.mask]))


HALO_ROWS = 2 * (ROLL_WINDOW - 1)   # MAD at a row needs medians of the previous 11 rows, each 11 rows deep


def with_global_chunks(df: DataFrame, order_cols: list, num_chunks: int | None = None,
                       halo: int = HALO_ROWS) -> tuple[DataFrame, object]:
    """Parity mode for windows over the whole (store, month)-sorted table, store boundaries ignored.

    Rows are range-partitioned on the sort key into chunks (tagged and written once, so ids are stable);
    the last ``halo`` rows of every chunk are copied to the next chunk as ``_halo`` rows. A window
    ``partitionBy(_chunk).orderBy(sort key)`` then sees every row's true predecessors, and no window
    ever runs on a single partition. Drop ``_halo`` rows after the window columns are computed.
    Returns the frame and the WindowSpec to use.
    """
    from storewatch.session import cut_lineage

    n = num_chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = cut_lineage(df.repartitionByRange(n, *[F.col(c).asc_nulls_last() for c in order_cols])
                         .withColumn("_chunk", F.spark_partition_id()).withColumn("_halo", F.lit(False)))
    sizes = tagged.groupBy("_chunk").count().where(F.col("count") < halo).limit(1).count()
    if sizes and n > 1:   # a chunk shorter than the halo would need rows from two chunks back
        return with_global_chunks(df, order_cols, max(1, n // 2), halo)
    tail_w = Window.partitionBy("_chunk").orderBy(*[F.col(c).desc_nulls_first() for c in order_cols])
    tail = (tagged.withColumn("_r", F.row_number().over(tail_w)).where(F.col("_r") <= halo).drop("_r")
            .withColumn("_chunk", F.col("_chunk") + 1).withColumn("_halo", F.lit(True)))
    w = Window.partitionBy("_chunk").orderBy(*[F.col(c).asc_nulls_last() for c in order_cols])
    return tagged.unionByName(tail), w
