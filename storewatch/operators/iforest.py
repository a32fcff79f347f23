"""Isolation forest as Spark jobs (the one-class fallback model).

1. sample: every row tries every tree with a hash against a rate that leaves about two samples' worth of rows per
   tree, whatever the table size; per tree the ``sample_size`` rows with the smallest hash are kept
   (window per tree: a few hundred rows; a table smaller than that is taken whole by every tree);
2. grow: ``groupBy(tree).applyInPandas`` grows one isolation tree per group with numpy (<= 2*256-1 nodes);
3. score: the forest (trees x nodes, a proven bound) is broadcast; ``mapInPandas`` walks all trees for
   some thousand rows at once, level by level, and returns 2^(-E[h] / c(n)).
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WALK_ROWS = 2048   # rows that walk the trees together

NODE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("tree", T.IntegerType()), ("node", T.IntegerType()), ("feature", T.IntegerType()), ("threshold", T.DoubleType()),
    ("left", T.IntegerType()), ("right", T.IntegerType()), ("size", T.IntegerType())]])


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(pdf: pd.DataFrame, n_features: int, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    x = np.array(pdf["x"].tolist(), dtype="float64").reshape(-1, n_features)
    rng = np.random.default_rng(seed * 100003 + tree)
    max_depth = int(math.ceil(math.log2(max(len(x), 2))))
    nodes = []                                   # node, feature, threshold, left, right, size

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(idx)])
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        spread = sub.max(axis=0) - sub.min(axis=0)
        candidates = np.flatnonzero(spread > 0)
        if len(candidates) == 0:
            return me
        f = int(rng.choice(candidates))
        lo, hi = sub[:, f].min(), sub[:, f].max()
        t = float(rng.uniform(lo, hi))
        go_left = sub[:, f] < t
        nodes[me][1], nodes[me][2] = f, t
        nodes[me][3] = build(idx[go_left], depth + 1)
        nodes[me][4] = build(idx[~go_left], depth + 1)
        return me

    build(np.arange(len(x)), 0)
    out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size"])
    out.insert(0, "tree", tree)
    return out.astype({"tree": "int32", "node": "int32", "feature": "int32", "left": "int32", "right": "int32",
                       "size": "int32"})


def fit_forest(df: DataFrame, feature_cols: list, key_cols: list, n_trees: int = 400, sample_size: int = 256,
               seed: int = 42) -> DataFrame:
    """Grow the forest; returns the node table (tree, node, feature, threshold, left, right, size)."""
    rate = min(1.0, 2.0 * sample_size / max(df.count(), 1))
    x = F.array(*[F.col(c).cast("double") for c in feature_cols])
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    h = F.pmod(F.xxhash64(F.lit(seed), F.col("_key"), F.col("tree")), F.lit(1 << 52))
    rows = (df.select(key.alias("_key"), x.alias("x"))
            .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).withColumn("_h", h)
            .where(F.col("_h") < F.lit(int(rate * (1 << 52)))))
    w = Window.partitionBy("tree").orderBy("_h", "_key")
    sample = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample_size).select("tree", "x")
    nf = len(feature_cols)
    return sample.groupBy("tree").applyInPandas(lambda p: _grow(p, nf, seed), NODE_SCHEMA)


def _walkable(part: pd.DataFrame, c_table: np.ndarray) -> tuple:
    """A tree whose leaves lead to themselves, so that all rows take the same number of steps: feature and threshold of each node, its right
    and left child side by side, the path length that a row ending there has, and the number of steps."""
    feat, thr, left, right, size = (part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size"))
    leaf, own = feat < 0, np.arange(len(part))
    kids = np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], axis=1).ravel()
    depth = np.zeros(len(part))
    for node in np.flatnonzero(~leaf):     # parents come before their children
        depth[left[node]] = depth[right[node]] = depth[node] + 1
    return (np.where(leaf, 0, feat).astype(np.int64), np.where(leaf, -np.inf, thr), kids.astype(np.int64), depth + c_table[size],
            int(depth.max()))


def _path_sums(x: np.ndarray, trees: list) -> np.ndarray:
    """Sum of each row's path lengths through all trees; ``x`` is small enough to stay in the processor's cache."""
    flat, row = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    total = np.zeros(len(x))
    for feat, thr, kids, path, steps in trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(steps):
            go_left = flat.take(row + feat.take(node)) < thr.take(node)
            node = kids.take(2 * node + go_left)
        total += path.take(node)
    return total


def score_forest(df: DataFrame, forest: DataFrame, feature_cols: list, out: str = "anomaly",
                 sample_size: int = 256) -> DataFrame:
    """Anomaly score in (0, 1] for every row (higher = more isolated)."""
    nodes = forest.orderBy("tree", "node").toPandas()      # <= trees * (2 * sample_size - 1) rows
    c_table = np.array([_c(i) for i in range(2 * sample_size + 2)])
    packed = [_walkable(part, c_table) for _, part in nodes.groupby("tree", sort=True)]
    bc = df.sparkSession.sparkContext.broadcast(packed)
    c_n = _c(float(nodes.loc[nodes.node == 0, "size"].mean()))    # the rows the trees really hold
    nf = len(feature_cols)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])

    def score(batches):
        forest_ = bc.value
        for pdf in batches:
            x = pdf[feature_cols].to_numpy(dtype="float64").reshape(-1, nf)
            depth_sum = np.concatenate([_path_sums(x[at:at + WALK_ROWS], forest_) for at in range(0, len(x), WALK_ROWS)] or [np.zeros(0)])
            pdf[out] = np.power(2.0, -(depth_sum / len(forest_)) / c_n)
            yield pdf

    return df.mapInPandas(score, schema)
