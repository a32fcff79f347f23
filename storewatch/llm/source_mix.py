"""Mixing sources to target weights by capped water-filling and seeded repetition.

Every source has a weight and may be repeated at most ``max_epochs`` times.  The words of the whole
corpus are shared out by weight; a source whose share exceeds its cap is clamped there and the excess
goes to the others by weight, until no source is above its cap.  With the sources in ascending order of
cap / weight this is one pass of prefix sums: clamping the first k sources leaves the level
``(total - their caps) / (remaining weight)``, which grows while sources are rightly clamped and falls
afterwards, so the final level is the largest of them and a target is ``min(cap, weight * level)``.

A source that needs m epochs takes every document floor(m) times and a seeded part of them once more:
documents in the order of md5(seed:id) until the remaining words are used up, cut where the running sum
comes nearest.  Reruns agree, and a source misses its target by at most half of its cut document.

Scale: texts are read once for their sizes; everything after that is a narrow (id, source, size) table.
A source is never sorted or summed as one group: sizes are first summed per (source, hash bucket) with
map-side combine, the bucket in which the cut falls is found on that table (``BUCKETS`` rows a source),
and only the rows of that one bucket, 1/4096 of a source, are put in order.

Defined cases: a null text has size 0; sources are ordered by code point, null last, and a null source
is a source; documents of size 0 are taken 0 words; repeated rows count as often as they occur; an empty
table gives an empty result; with no words at all every target is 0.  A null id hashes as ''.  Other
columns are not read by ``mix_plan`` and carried by ``mix``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storewatch.session import Scope, cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096  # three hexadecimal digits of the seeded order


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row per source: weight, source_size, target, whole epochs and the words of the partial one."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()          # one row per source
    place = F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1
    named = by_source.select("*", place.alias("place"), (max_epochs * F.col("source_size")).alias("cap"))
    weighed = named.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                                                      (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    before = everything.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    clamped = [F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("cap", "weight")]
    left = (F.sum("source_size").over(everything) - clamped[0]).cast("double")
    level = weighed.withColumn("level", left / (F.sum("weight").over(everything) - clamped[1]))
    filled = level.withColumn("target", F.least(F.col("cap").cast("double"),
                                                F.col("weight") * F.max("level").over(everything)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (filled.withColumn("whole", whole.cast("long"))
            .withColumn("budget", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
            .select("source", "weight", "source_size", "target", "whole", "budget"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: id, size, source_size, target (both of its source), taken words and copies.

    ``weights`` repeat over the sources in code point order.  ``keep``: further columns to carry along."""
    if min(weights) <= 0 or max_epochs < 1:
        raise ValueError("weights and max_epochs must be positive")
    spark = docs.sparkSession
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    carried = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep])
    with Scope(spark) as scope:
        sizes = scope.table(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                        word_count(F.col(text_col)).alias("size"), order.alias("order"),
                                        carried.alias("carried"))
                            .withColumn("bucket", F.conv(F.substring("order", 1, 3), 16, 10).cast("int")))
        goal = scope.table(targets(sizes, weights, max_epochs))
        buckets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
        upto = Window.partitionBy("source").orderBy("bucket")
        running = buckets.withColumn("after", F.sum("size").over(upto))
        cut = (running.join(goal, _same(running, goal), "left")
               .filter(((F.col("after") - F.col("size")) < F.col("budget")) & (F.col("after") > F.col("budget")))
               .select(running["source"], F.col("bucket").alias("cut"), (F.col("after") - F.col("size")).alias("base")))
        last = (running.join(goal, _same(running, goal), "left").filter(F.col("after") <= F.col("budget"))
                .groupBy(running["source"]).agg(F.max("bucket").alias("full")))
        found = goal.join(cut, _same(goal, cut), "left").select(goal["*"], cut["cut"], cut["base"])
        found = scope.table(found.join(last, _same(found, last), "left").select(found["*"], last["full"]))
        rows = sizes.join(found, _same(sizes, found)).select(
            "id", "size", "carried", "order", "bucket", sizes["source"], "source_size", "target", "whole", "budget",
            "cut", "base", F.coalesce(F.col("full"), F.lit(-1)).alias("full"))
        at_cut = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
        order_in = Window.partitionBy("source").orderBy("order", "id", "size").rowsBetween(
            Window.unboundedPreceding, 0)
        edge = rows.filter(at_cut).withColumn("run", F.col("base") + F.sum("size").over(order_in))
        edge = edge.withColumn("extra", 2 * F.col("run") - F.col("size") <= 2 * F.col("budget")).drop("run")
        bulk = rows.filter(~at_cut).withColumn("extra", F.col("bucket") <= F.col("full"))
        done = bulk.unionByName(edge).withColumn("copies", (F.col("whole") + F.col("extra").cast("int")).cast("int"))
        return cut_lineage(done.select(F.col("id").alias(id_col), "size", "source_size", "target",
                                       (F.col("size") * F.col("copies")).alias("taken"), "copies",
                                       *[F.col(f"carried.`{c}`").alias(c) for c in keep]))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the plan takes it."""
    names = list(docs.columns)
    # positions keep names apart from the plan's own columns
    kept = "_kept_"
    while any(c.startswith(kept) for c in names):
        kept += "_"
    safe = docs.select("*", *[F.col(f"`{c}`").alias(f"{kept}{i}") for i, c in enumerate(names)])
    plan = mix_plan(safe, keep=tuple(f"{kept}{i}" for i in range(len(names))), **options)
    again = plan.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*[F.col(f"{kept}{i}").alias(c) for i, c in enumerate(names)])
