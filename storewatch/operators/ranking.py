"""Exact ranks, quantiles and running sums per group without sending a whole group to one task.

A window ``partitionBy(month).orderBy(score)`` puts every row of a month into one task; with one month
holding a third of all rows that task is the job. Instead:

1. pre-aggregate ties: one row per (group, value) with counts / sums (map-side combine);
2. ``repartitionByRange`` on (group, value): every partition holds a contiguous, bounded slice of the
   order, so a hot group is spread over many partitions; tag the partition id and checkpoint so every
   later pass (and every retry after a lost executor) sees the same slices;
3. per (partition, group) totals -> a table of at most partitions + groups rows -> exclusive running
   offsets over the partition index;
4. running sums inside each (partition, group) slice + offset = exact running sums per group.

Quantiles (linear interpolation, as pandas / DuckDB ``quantile_cont``) then come from one aggregate,
and per-row ranks from one equi-join on (group, value).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storewatch.session import cut_lineage

_ALL = "_all_rows"


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def value_ranks(df: DataFrame, group_cols: Sequence[str], value_col: str, sum_cols: Sequence[str] = (),
                num_partitions: int | None = None) -> DataFrame:
    """One row per (group, distinct non-null value) with

    - ``n``: rows with this value, ``lt``: rows with a smaller value, ``tot``: rows in the group;
    - for every ``s`` in ``sum_cols``: ``s`` (sum at this value), ``cum_s`` (inclusive running sum in
      value order) and ``tot_s`` (group total).

    Rows whose group key or value is NULL are left out.
    """
    g = list(group_cols) or [_ALL]
    base = df if group_cols else df.withColumn(_ALL, F.lit(0))
    cond = F.col(value_col).isNotNull()
    for c in g:
        cond = cond & F.col(c).isNotNull()
    measures = ["n"] + list(sum_cols)
    distinct = (base.where(cond)
                .groupBy(*g, value_col)
                .agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in sum_cols]))
    sliced = (distinct.repartitionByRange(_partitions(df, num_partitions), *[F.col(c) for c in g], F.col(value_col))
              .withColumn("_pid", F.spark_partition_id()))
    sliced = cut_lineage(sliced)

    per_slice = sliced.groupBy("_pid", *g).agg(*[F.sum(m).alias(f"_p_{m}") for m in measures])
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    offsets = per_slice.select(
        "_pid", *g,
        *[F.coalesce(F.sum(f"_p_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_p_{m}").over(whole).alias(f"_t_{m}") for m in measures],
    )
    inside = Window.partitionBy("_pid", *g).orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("_pid", *g, value_col, *measures,
                          *[F.sum(m).over(inside).alias(f"_l_{m}") for m in measures])
    out = local.join(offsets, ["_pid", *g])
    cols = [*g, value_col, "n",
            (F.col("_o_n") + F.col("_l_n") - F.col("n")).alias("lt"),
            F.col("_t_n").alias("tot")]
    for s in sum_cols:
        cols += [F.col(s), (F.col(f"_o_{s}") + F.col(f"_l_{s}")).alias(f"cum_{s}"), F.col(f"_t_{s}").alias(f"tot_{s}")]
    res = out.select(*cols)
    return res if group_cols else res.drop(_ALL)


def group_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, num_partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group: one row per group with one column per prob."""
    names = list(names or [f"q_{str(p).replace('.', '_')}" for p in probs])
    vr = value_ranks(df, group_cols, value_col, num_partitions=num_partitions)
    aggs = []
    for p, name in zip(probs, names):
        h = (F.col("tot") - 1).cast("double") * F.lit(float(p))
        lo_rank, hi_rank = F.floor(h), F.ceil(h)
        v = F.col(value_col).cast("double")
        aggs += [F.max(F.when(F.col("lt") <= lo_rank, v)).alias(f"_lo_{name}"),
                 F.max(F.when(F.col("lt") <= hi_rank, v)).alias(f"_hi_{name}"),
                 F.max(h - lo_rank).alias(f"_f_{name}")]
    g = list(group_cols)
    agg = vr.groupBy(*g).agg(*aggs) if g else vr.agg(*aggs)
    return agg.select(*g, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in names])


def global_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                     num_partitions: int | None = None) -> list:
    """Exact quantiles over the whole table as Columns: fields of one scalar-subquery struct (usable in any
    expression: no join, no cross product, one ranking for all of them)."""
    names = [f"q{i}" for i in range(len(probs))]
    q = group_quantiles(df, [], value_col, probs, names=names, num_partitions=num_partitions)
    row = q.select(F.struct(*names).alias("q")).scalar()
    return [row.getField(n) for n in names]


def with_percent_rank(df: DataFrame, group_cols: Sequence[str], value_col: str, out_col: str,
                      descending: bool = False, num_partitions: int | None = None) -> DataFrame:
    """``percent_rank()`` within group ((rank-1)/(n-1), 0 for one-row groups), computed without a
    per-group window. ``descending`` ranks the largest value first. NULL values get NULL."""
    key = f"_{value_col}_key"
    src = df.withColumn(key, -F.col(value_col) if descending else F.col(value_col))
    vr = value_ranks(src, group_cols, key, num_partitions=num_partitions)
    pr = vr.select(*group_cols, key,
                   F.when(F.col("tot") > 1, F.col("lt") / (F.col("tot") - 1)).otherwise(F.lit(0.0)).alias(out_col))
    return src.join(pr, [*group_cols, key], "left").drop(key)


def _group_name(cols: Sequence[str]) -> F.Column:
    """Key columns as one text, each with its length before it, so that different keys never meet; NULL when one of them is missing
    (a row without its group key is not ranked)."""
    texts = [F.col(c).cast("string") for c in cols]
    return F.concat(*[x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)]) if cols else F.lit("")


def with_percent_ranks(df: DataFrame, key_cols: Sequence[str], specs: Sequence[tuple],
                       num_partitions: int | None = None) -> DataFrame:
    """Several ``percent_rank`` columns in one distributed pass.

    ``specs``: ``(out_col, group_cols, value_col, descending)``. ``key_cols`` must identify a row. The
    values of all specs are stacked into one (spec, group, value) table, ranked once by
    :func:`value_ranks` and pivoted back, so k rank columns cost one checkpoint instead of k.
    """
    keys = list(key_cols)
    groups = list(dict.fromkeys(tuple(gcols) for _, gcols, _, _ in specs))
    entries = [F.struct(F.lit(i).alias("_spec"), F.col(f"_g{groups.index(tuple(gcols))}").alias("_grp"),
                        (-F.col(vcol) if desc else F.col(vcol)).cast("double").alias("_v"))
               for i, (_, gcols, vcol, desc) in enumerate(specs)]
    named = df.withColumns({f"_g{i}": _group_name(g) for i, g in enumerate(groups)})   # a group's name once a row, not once a spec
    stacked = named.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*")
    vr = value_ranks(stacked, ["_spec", "_grp"], "_v", num_partitions=num_partitions)
    pr = vr.select("_spec", "_grp", "_v",
                   F.when(F.col("tot") > 1, F.col("lt") / (F.col("tot") - 1)).otherwise(F.lit(0.0)).alias("_pr"))
    # four narrow columns travel to the row's key, not one wide row of mostly empty maxima each
    ranked = stacked.join(pr, ["_spec", "_grp", "_v"], "left").select(*keys, "_spec", "_pr").repartition(*keys)
    wide = ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("_spec") == i, F.col("_pr"))).alias(spec[0]) for i, spec in enumerate(specs)])
    return df.join(wide, keys, "left")
