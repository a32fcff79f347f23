"""Tree and network learners: against brute force, in one task against over blocks, reruns."""
import numpy as np
import pytest

from storewatch.operators import blocks as B
from storewatch.operators import boosting, forest, neural


def rows_of(n=600, width=5, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    x[:, 1] = rng.integers(0, 2, n)
    y = (x[:, 0] * x[:, 2] + x[:, 1] + 0.3 * rng.normal(size=n) > 0.6).astype(float)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = rows_of()
    return spark.createDataFrame([(str(i), [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "id string, x array<double>, y double")


def by_hand(bins, y, score, cuts, p):
    """Best-first tree by trying every split of every leaf on its rows, whole numbers as the grower sums them."""
    prob = 1 / (1 + np.exp(-score))
    g, w = np.rint((prob - y) * boosting.UNIT), np.rint(prob * (1 - prob) * boosting.UNIT)

    def best(rows):
        top = (0.0, None, None)
        for f, cut in enumerate(cuts):
            for b in range(len(cut)):
                left = bins[rows, f] <= b
                if min(left.sum(), (~left).sum()) < p.min_rows:
                    continue
                part = lambda r: g[r].sum() ** 2 / max(w[r].sum() + p.l2, 1e-12)
                gain = part(rows[left]) + part(rows[~left]) - part(rows)
                if gain > top[0]:
                    top = (gain, f, b)
        return top

    leaves = [(np.arange(len(y)), best(np.arange(len(y))))]
    while len(leaves) < p.leaves:
        i = max(range(len(leaves)), key=lambda k: leaves[k][1][0])
        rows, (gain, f, b) = leaves[i]
        if f is None or gain <= 1e-9:
            break
        left = bins[rows, f] <= b
        leaves[i:i + 1] = [(r, best(r)) for r in (rows[left], rows[~left])]
    value = np.empty(len(y))
    for rows, _ in leaves:
        value[rows] = -(g[rows].sum() / boosting.UNIT) / (w[rows].sum() / boosting.UNIT + p.l2)
    return value, len(leaves)


def test_leaf_wise_tree_equals_brute_force(spark, table):
    x, y = rows_of()
    cuts = boosting.quantile_cuts(table, 5)
    assert [len(c) for c in cuts][1] == 1 and all((np.diff(c) > 0).all() for c in cuts)
    p = boosting.Boosting(rounds=3, rate=0.3, leaves=31, min_rows=5)
    block = B.Block(0, np.arange(len(y), dtype=np.uint64), x, y, None)
    model = boosting.boost_block(block, cuts, p)
    bins, score = boosting.to_bins(x, cuts), np.full(len(y), model.start)
    for tree in model.trees:
        value, leaves = by_hand(bins, y, score, cuts, p)
        assert leaves == 31 == (tree.feature < 0).sum()
        assert np.allclose(tree.value[tree.leaf_of(bins)], value, atol=1e-12)
        score = score + p.rate * value
    assert np.allclose(model.predict(x), 1 / (1 + np.exp(-score)))


@pytest.mark.parametrize("p", [boosting.Boosting(5, 0.2, leaves=8, min_rows=10, row_share=0.7, column_share=0.8),
                               boosting.Boosting(23, 0.1, leaves=8, depth=3, l2=1.0)])
def test_boosting_in_a_task_and_over_blocks_is_the_same(spark, table, p):
    cuts = boosting.quantile_cuts(table, 5)
    one, many = B.to_blocks(table, ["id"]), B.to_blocks(table, ["id"], block_rows=130)
    assert one.count() == 1 and many.count() == 5 and sum(r.n for r in many.select("n").collect()) == 600
    a = B.fit_in_task(one, {"m": lambda b: boosting.boost_block(b, cuts, p)})["m"]
    b = boosting.boost_blocks(many, cuts, p)
    for s, t in zip(a.trees, b.trees, strict=True):
        assert (s.feature == t.feature).all() and (s.bin == t.bin).all() and (s.value == t.value).all()
        assert (s.feature < 0).sum() <= 8
    assert len(a.trees) == p.rounds


def test_boosting_learns_and_one_class_of_features(spark):
    x, y = rows_of(800)
    block = B.Block(0, np.arange(800, dtype=np.uint64), x, y, None)
    cuts = [np.unique(c)[:-1] for c in x.T]
    model = boosting.boost_block(block, cuts, boosting.Boosting(30, 0.2, min_rows=5))
    assert ((model.predict(x) > 0.5) == y).mean() > 0.95
    flat = boosting.boost_block(B.Block(0, block.h, np.zeros_like(x), y, None), [np.zeros(0)] * 5, boosting.Boosting(2, 0.2))
    assert np.allclose(flat.predict(x), y.mean())


def test_forest_trees_equal_brute_force_splits(spark, table):
    x, y = rows_of()
    made = forest.fit_forest(B.to_blocks(table, ["id"], block_rows=200), n_trees=30, seed=3)
    again = forest.fit_forest(B.to_blocks(table, ["id"], block_rows=200), n_trees=30, seed=3)
    assert len(made.trees) == 30 and np.array_equal(made.predict(x), again.predict(x))
    assert ((made.predict(x) > 0.5) == y).mean() > 0.97

    def depth(t, i=0):
        return 0 if t.feature[i] < 0 else 1 + max(depth(t, t.left[i]), depth(t, t.right[i]))

    assert max(depth(t) for t in made.trees) > 8
    # a tree that tries every feature takes the split of least impurity everywhere and ends pure
    w = np.where(y > 0, 2.0, 0.5)

    class AllFeatures:
        def permutation(self, n):
            return np.arange(n)

    old, forest.np.sqrt = forest.np.sqrt, lambda n: n
    try:
        tree = forest.grow_tree(x, y, w, AllFeatures())
    finally:
        forest.np.sqrt = old

    def check(i, rows):
        if tree.feature[i] < 0:
            assert len(np.unique(y[rows])) == 1 or (x[rows] == x[rows][0]).all()
            return
        gini = lambda r: (w[r] * y[r]).sum() * (w[r] * (1 - y[r])).sum() / w[r].sum()
        goes = x[rows, tree.feature[i]] <= tree.threshold[i]
        least = min(gini(rows[x[rows, f] <= v]) + gini(rows[x[rows, f] > v]) for f in range(5) for v in np.unique(x[rows, f])[:-1])
        assert np.isclose(gini(rows[goes]) + gini(rows[~goes]), least)
        check(tree.left[i], rows[goes])
        check(tree.right[i], rows[~goes])

    check(0, np.arange(len(y)))


def test_forest_sample_is_bounded():
    taken = [forest.draw(1, b, 7, 1000, 0.05)[1].sum() for b in range(40)]
    assert 1500 < sum(taken) < 2500 and len(set(taken)) > 3


def test_network_gradient_is_numeric_gradient():
    x, y = rows_of(40)
    t = neural.Training(hidden=(6, 4))
    net = neural.Network(neural.first_layers(5, t), np.zeros(5), np.ones(5))
    net.layers = [(w, b + 0.05 * (1 + np.arange(len(b)))) for w, b in net.layers]  # away from the kink at 0
    mask = neural.dropout_mask(np.arange(40, dtype=np.uint64), 6, t, 3)
    assert set(np.unique(mask)) == {0.0, 1.25} and 0.1 < (mask == 0).mean() < 0.3
    v = neural.flat(net.layers)
    got = neural.gradient(net, x, y, mask)
    for i in range(0, len(v), 3):
        step = np.zeros_like(v)
        step[i] = 1e-6
        loss = lambda u: neural.gradient(neural.Network(neural.shaped(u, net.layers), net.mean, net.scale), x, y, mask)[-2]
        assert np.isclose(got[i], (loss(v + step) - loss(v - step)) / 2e-6, atol=1e-4)


def test_network_in_a_task_and_over_blocks(spark, table):
    x, y = rows_of()
    t = neural.Training(hidden=(16, 8), epochs=6, batch=60, rate=0.02)
    one = B.fit_in_task(B.to_blocks(table, ["id"]), {"n": lambda b: neural.train_block(b, t)})["n"]
    many = neural.train_blocks(B.to_blocks(table, ["id"], block_rows=200), 5, neural.Training(hidden=(16, 8), epochs=1, batch=60, rate=0.02))
    short = neural.train_block(B.Block.of(B.to_blocks(table, ["id"]).first().asDict()), neural.Training(hidden=(16, 8), epochs=1, batch=60, rate=0.02))
    assert np.allclose(many.predict(x), short.predict(x), atol=1e-8)
    assert ((one.predict(x) > 0.5) == y).mean() > 0.85
    again = B.fit_in_task(B.to_blocks(table, ["id"]), {"n": lambda b: neural.train_block(b, t)})["n"]
    assert np.array_equal(one.predict(x), again.predict(x))


def test_waves_follow_the_depth_and_trees_stay_the_same():
    x, y = rows_of(3000, seed=4)
    cuts = [np.unique(c)[:-1] for c in x.T]
    bins, h, score = boosting.to_bins(x, cuts), np.arange(3000, dtype=np.uint64), np.zeros(3000)
    first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])
    p = boosting.Boosting(1, 0.1, leaves=31, min_rows=20)

    def grow(ahead):
        waves = []

        def histograms(nodes, wanted):
            waves.append(len(wanted))
            return boosting.block_histograms(bins, y, h, score, nodes, wanted, p, 0, first)

        return boosting.Grower(cuts, p, 0, histograms, ahead).grow(), len(waves)

    def depth(t, i=0):
        return 0 if t.feature[i] < 0 else 1 + max(depth(t, t.left[i]), depth(t, t.right[i]))

    (a, slow), (b, fast) = grow(0), grow(boosting.AHEAD)
    assert all(np.array_equal(getattr(a, c), getattr(b, c)) for c in ("feature", "bin", "left", "right", "value"))
    assert fast < slow and fast <= depth(b) + 2


def test_a_step_over_kept_blocks_is_one_job_of_one_stage(spark, table):
    sc = spark.sparkContext
    kept = B.keep(B.to_blocks(table, ["id"], block_rows=130), lambda b: b.y)
    assert B.kept_sum(kept, lambda y: np.array([len(y), y.sum()]), 2)[0] == 600
    sc.setJobGroup("kept", "step")
    B.kept_sum(kept, lambda y: np.array([y.sum()]), 1)
    sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("kept")]
    ran = [s for j in jobs for s in j.stageIds if (i := sc.statusTracker().getStageInfo(s)) and i.numCompletedTasks]
    assert len(jobs) == 1 and len(ran) == 1
    kept.unpersist()
