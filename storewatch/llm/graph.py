"""Connected components of an edge table by alternating star operations.

Each round sends, for every node, its larger neighbours to the smallest node around it (large star), then
its smaller neighbours and itself to the smallest of them (small star); the number of rounds grows with the
logarithm of the longest path.  Before each round every task contracts its own edges to a forest, which
shortens chains and never lengthens the table.  Rounds are cut by written tables; nothing is collected but
a row count and a checksum.  A node with very many neighbours is one key of joins that AQE splits.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.session import Scope

BUFFER = 1 << 20  # edges contracted together in a task


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the pairs (a[i], b[i]) into ``root`` (every entry points at its root, a smallest index)."""
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all but the smallest, over the given edges."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = merge(np.arange(len(nodes)), place[:len(a)], place[len(a):])
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contract(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            size += batch.num_rows
            if size >= BUFFER:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scope: Scope) -> DataFrame:
    """node, component (smallest node reachable) of every node that is not the smallest of its component.

    ``edges``: long columns a, b, not null; direction, repeats and self-loops do not matter."""
    now = scope.table(_contract(edges.filter("a <> b")))
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scope.table(_contract(large))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scope.table(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = (row.n, row.s)
