"""Mini-batches from pieces: every row once an epoch, jobs read only their pieces, blocks in a task equal blocks over jobs."""
import numpy as np
import pytest

from storewatch.operators import blocks as B
from storewatch.operators import neural


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(900, 4)), 1)
    y = (x[:, 0] + x[:, 1] > 0.3).astype(float)
    df = spark.createDataFrame([(str(i), [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))],
                               "id string, x array<double>, y double")
    made = B.to_blocks(df, ["id"], block_rows=250).cache()
    assert made.count() == 4
    return made


T = neural.Training(hidden=(12, 6), epochs=3, batch=60, rate=0.02)


def test_an_epoch_takes_every_row_once(blocks):
    h = np.concatenate([B.Block.of(r.asDict()).h for r in blocks.collect()])
    piece = neural.piece_of(h, 15, T)
    batches = [neural.pieces_of(e, 15, T) for e in range(2)]
    for b in batches:
        assert b.shape == (15, neural.PIECES) and sorted(b.reshape(-1)) == list(range(60))
        sizes = [np.isin(piece, p).sum() for p in b]
        assert sum(sizes) == 900 and min(sizes) > 20
    assert {frozenset(p) for p in batches[0]} != {frozenset(p) for p in batches[1]}


def test_a_step_reads_only_its_pieces(spark, blocks):
    source = neural.OverBlocks(blocks, 4, T)
    source.deal(15)
    assert source.kept.getNumPartitions() == 60 * source.parts
    net = neural.Network(neural.first_layers(4, T), np.zeros(4), np.ones(4))
    h = np.concatenate([B.Block.of(r.asDict()).h for r in blocks.collect()])
    pieces = neural.pieces_of(0, 15, T)[3]
    sc = spark.sparkContext
    source.gradient(net, pieces, 3)
    sc.setJobGroup("pieces", "step")
    made = source.gradient(net, pieces, 3)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert made[-1] == np.isin(neural.piece_of(h, 15, T), pieces).sum()
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("pieces")]
    tasks = [i.numTasks for j in jobs for s in j.stageIds if (i := sc.statusTracker().getStageInfo(s)) and i.numCompletedTasks]
    assert tasks == [neural.PIECES * source.parts]
    source.kept.unpersist()


def test_network_of_several_blocks_in_a_task_and_over_jobs(blocks):
    x = np.round(np.random.default_rng(5).normal(size=(50, 4)), 1)
    a = B.fit_in_task(blocks, {"n": lambda rows: neural.train_in_task(rows, T)}, whole=True)["n"]
    b = neural.train_blocks(blocks, 4, T)
    assert np.allclose(a.predict(x), b.predict(x), atol=1e-8)
    assert ((a.predict(x) > 0.5) == (x[:, 0] + x[:, 1] > 0.3)).mean() > 0.9
