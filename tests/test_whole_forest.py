"""The forest on whole bootstraps, grown level by level; packed columns; boosting of several blocks inside one task."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from storewatch.operators import blocks as B
from storewatch.operators import boosting, forest


def rows_of(n, seed=0, noise=0.6):
    """Four numbers, two kinds one-hot (6 and 3 slots, some rows without one)."""
    rng = np.random.default_rng(seed)
    x = np.zeros((n, 13))
    x[:, :4] = np.round(rng.normal(size=(n, 4)) * 30, 1)
    x[:, 1] = np.round(x[:, 1], -1)
    kinds = rng.integers(0, 7, n), rng.integers(0, 3, n)
    x[kinds[0] < 6, 4 + kinds[0][kinds[0] < 6]] = 1
    x[np.arange(n), 10 + kinds[1]] = 1
    y = (x[:, 0] / 30 + (kinds[0] == 2) - (kinds[1] == 1) + noise * rng.normal(size=n) > 0.7).astype(float)
    return x, y


def table_of(x, count=1):
    """Rows of packed columns, in ``count`` blocks."""
    parts = np.array_split(x, count)
    packed = [B.packed_columns(B.pack(p)) for p in parts]
    return forest.Rows((j, b, packed[b][j], len(parts[b])) for j in range(x.shape[1]) for b in range(count))


def test_packed_columns_come_back():
    x, _ = rows_of(70_000)
    x[:, 2] = np.random.default_rng(1).random(70_000)          # more values than codes
    x[5, 3], x[6, 3] = -1e300, 1e-300
    data = B.pack(x)
    assert np.array_equal(B.unpack(data, len(x)), x) and len(data) < 0.2 * x.nbytes
    kinds = [c[0] for c in B.packed_columns(data)]
    assert len(set(kinds)) == 4
    one = np.array([[3.0, 0.0, 1.0]])
    assert np.array_equal(B.unpack(B.pack(one), 1), one)


@pytest.mark.parametrize("count", [1, 3])
def test_levels_grow_the_tree_of_brute_force(count):
    x, y = rows_of(900)
    pay = (np.random.default_rng(2).poisson(1.0, 900).astype(np.uint8) << 1) | y.astype(np.uint8)
    drawn, times = np.flatnonzero(pay >> 1), pay >> 1
    weight = (0.7, 2.0)

    class InOrder:
        def permutation(self, n):
            return np.arange(n)

        def random(self, shape):
            return np.tile(np.arange(shape[1], dtype=float), (shape[0], 1))

    old, forest.np.sqrt = forest.np.sqrt, lambda n: n   # every feature is tried
    try:
        tree = forest.grow_tree(x[drawn], y[drawn], times[drawn] * np.where(y[drawn] > 0, weight[1], weight[0]), InOrder())
    finally:
        forest.np.sqrt = old
    total = np.zeros(900)
    forest.grow_and_score(table_of(x, count), pay, weight, InOrder(), total, tries=13)
    assert np.abs(total - tree.predict(x)).max() < 1e-12     # drawn rows and all others


def test_some_features_tried_still_end_pure():
    x, y = rows_of(2000, noise=2.0)
    x[:, 2] = np.random.default_rng(3).permutation(2000)     # tells every row apart
    pay = (np.ones(2000, np.uint8) << 1) | y.astype(np.uint8)
    old = forest.CHUNK_NODES, forest.CHUNK_PAIRS
    totals = []
    for sizes in (old, (7, 50)):
        forest.CHUNK_NODES, forest.CHUNK_PAIRS = sizes
        try:
            total = np.zeros(2000)
            forest.grow_and_score(table_of(x), pay, (1.0, 1.0), np.random.default_rng(4), total)
        finally:
            forest.CHUNK_NODES, forest.CHUNK_PAIRS = old
        totals.append(total)
    assert all(np.array_equal(t, y) for t in totals)


def test_every_tree_draws_from_the_whole_table():
    drawn = [sum(int(forest.draws_of(42, b, t, 10_000).sum()) for b in range(6)) for t in range(5)]
    assert all(59_000 < d < 61_000 for d in drawn) and not hasattr(forest, "MAX_ROWS")


def test_forest_scores_do_not_depend_on_tasks(spark):
    x, y = rows_of(1500, seed=5, noise=0.2)
    df = spark.createDataFrame([(str(i), [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))],
                               "id string, x array<double>, y double")
    train, rest = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    other = B.to_blocks(rest, ["id"], block_rows=200, texts=True).withColumn("bucket", forest.REST - F.col("bucket"))
    every = B.to_blocks(train, ["id"], block_rows=300, texts=True).unionByName(other).cache()
    assert every.count() == 6
    made = [{r.k: r.score for r in forest.forest_scores(every, 20, seed=3, groups=g).collect()} for g in (1, 3)]
    assert len(made[0]) == 1500 and all(abs(made[1][k] - v) < 1e-12 for k, v in made[0].items())
    right = [(made[0][f'{{"id":"{i}"}}'] > 0.5) == bool(t) for i, t in enumerate(y)]
    assert np.mean([r for i, r in enumerate(right) if i % 4]) > 0.98 and np.mean(right[::4]) > 0.85
    flipped = every.withColumn("y", F.when(F.col("bucket") < 0, F.col("state")).otherwise(F.col("y")))
    flipped = flipped.withColumn("y", F.coalesce("y", F.expr("cast(repeat(chr(0), 8 * n) as binary)")))   # the rest's labels are not read
    assert {r.k: r.score for r in forest.forest_scores(flipped, 20, seed=3, groups=1).collect()} == made[0]


def test_boosting_of_several_blocks_in_one_task(spark):
    x, y = rows_of(1200, seed=7)
    df = spark.createDataFrame([(str(i), [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))],
                               "id string, x array<double>, y double")
    cuts = boosting.quantile_cuts(df, 13)
    blocks = B.to_blocks(df, ["id"], block_rows=400).cache()
    for p in (boosting.Boosting(4, 0.1, leaves=31, min_rows=5, column_share=0.8), boosting.Boosting(4, 0.1, leaves=16, depth=4, l2=1.0, row_share=0.8)):
        a = B.fit_in_task(blocks, {"m": lambda rows, p=p: boosting.boost_in_task(rows, cuts, p)}, whole=True)["m"]
        b = boosting.boost_blocks(blocks, cuts, p)
        assert blocks.count() == 3
        for s, t in zip(a.trees, b.trees, strict=True):
            assert all(np.array_equal(getattr(s, c), getattr(t, c)) for c in ("feature", "bin", "left", "right", "value"))
