"""The conditional random field against enumeration; held-out accuracy on the labelled documents."""
import itertools
import zlib

import numpy as np
import pyarrow as pa

from storewatch.llm import quality
from storewatch.sources.tables import read_table

SF = "/root/testdata/sf0.01"


def test_forward_backward_enumerates_all_labelings():
    rng = np.random.default_rng(0)
    starts = np.array([0, 1, 5, 8])
    evidence, moves = rng.normal(size=8) * 2, rng.normal(size=(2, 2))
    marginal, pairs, log_z = quality.forward_backward(evidence, starts, moves)
    want, want_pairs, want_z = np.zeros((8, 2)), np.zeros((2, 2)), 0.0
    for a, b in zip(starts[:-1], starts[1:]):
        total, part, moved = 0.0, np.zeros((b - a, 2)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            s = np.exp(sum(evidence[a + i] for i, v in enumerate(y) if v) + sum(moves[p, q] for p, q in zip(y[:-1], y[1:])))
            total += s
            for i, v in enumerate(y):
                part[i, v] += s
            for p, q in zip(y[:-1], y[1:]):
                moved[p, q] += s
        want[a:b], want_pairs, want_z = part / total, want_pairs + moved / total, want_z + np.log(total)
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_line_features_of_odd_texts():
    texts = ["a b\nB c c\n\n$$ x|", "", None, "\n", "x\n", "same\nsame\nother\nsame", "é " * 3]
    features, size, starts = quality.line_features(pa.array(texts))
    assert np.diff(starts).tolist() == [4, 1, 1, 2, 2, 4, 1]
    assert size.tolist() == [3, 5, 0, 5, 0, 0, 0, 0, 1, 0, 4, 4, 5, 4, len(("é " * 3).encode())]
    at = {n: i for i, n in enumerate(quality.NAMES)}
    assert features.shape[1] == len(quality.NAMES) and np.isfinite(features).all()
    assert features[10:14, at["seen"]].tolist() == [0, 1, 0, 1]
    assert features[10:14, at["same_after"]].tolist() == [1, 0, 0, 0]
    assert features[1, at["again"]] == 1 / 3 and features[3, at["symbol"]] == 3 / 5
    alone = [quality.line_features(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(np.concatenate(alone), features)      # no leak between documents


def test_held_out_accuracy(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs.selectExpr("*", "1 as quality"), model)
    rows = (scored.join(labels.selectExpr("doc_id", "quality as label"), "doc_id")
            .select("doc_id", "quality_of_text.*", "label").collect())
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = [r.score for r in held if r.label], [r.score for r in held if not r.label]
    assert len(held) > 30 and bad
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97
    assert np.mean([r.predicted for r in held if r.label]) > 0.98


def test_odd_rows_and_labels(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "x " * 40_000), (4, "fine text here."), (4, "fine text here.")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(docs, none)
    got = quality.score_quality(docs, model).select("quality_of_text.*").collect()
    assert [tuple(r) for r in got] == [(0.5, 1)] * 5
    one = spark.createDataFrame([(2, 1), (4, 1), (None, 0), (1, 7), (99, 0)], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, one)).select("quality_of_text.score").collect()} == {1.0}
    mixed = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1)], "doc_id long, quality int")
    some = docs_of([(i, "good words in a line.\n" * 3 if i % 2 else "### $$$ !!!\n" * 3) for i in range(40)] + [(None, None)])
    model = quality.fit_quality(some, mixed)
    rows = quality.score_quality(some, model).select("doc_id", "text", "quality_of_text.*").collect()
    assert len(rows) == 41 and all(0 <= r.score <= 1 for r in rows)
    assert all((r.score >= 0.3) == (r.doc_id % 2 == 1) == (r.predicted == 1) for r in rows if r.doc_id is not None)
    assert quality.score_quality(docs_of([]), model).count() == 0
