"""The hidden Markov language model against enumeration of state paths and plain counts."""
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from storewatch.llm import hmm


def some_model(states=3, classes=5, seed=0):
    rng = np.random.default_rng(seed)
    return hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(classes + 1), states))


def by_paths(obs, m):
    """Probability and expected counts of a text by listing all state paths."""
    total, first, moves, emits = 0.0, np.zeros(len(m.first)), np.zeros_like(m.move), np.zeros_like(m.emit)
    for path in itertools.product(range(len(m.first)), repeat=len(obs)):
        p = m.first[path[0]] * math.prod(m.emit[s, o] for s, o in zip(path, obs)) * math.prod(m.move[a, b] for a, b in zip(path, path[1:]))
        total += p
        first[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for s, o in zip(path, obs):
            emits[s, o] += p
    return total, first / total, moves / total, emits / total


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_recursions_equal_path_enumeration(size):
    m, rng = some_model(), np.random.default_rng(3)
    texts = [rng.integers(0, 6, n) for n in (7, 1, 5, 2, 6, 4)]
    obs, starts = np.concatenate(texts).astype(np.int64), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [by_paths(t, m) for t in texts]
    assert np.allclose(hmm.log_likelihoods(obs, starts, m, size), np.log([w[0] for w in want]), atol=1e-12)
    for got, i in zip(hmm.expected_counts(obs, starts, m, size), (1, 2, 3)):
        assert np.allclose(got, sum(w[i] for w in want), atol=1e-12)


def test_very_long_text_is_scaled():
    m, rng = some_model(4, 50), np.random.default_rng(2)
    obs, starts = rng.integers(0, 51, 30_000).astype(np.int64), np.array([0, 1, 30_000])
    a = m.first * m.emit[:, obs[1]]
    total = np.log(a.sum())
    for o in obs[2:]:
        a = (a / a.sum()) @ m.move * m.emit[:, o]
        total += np.log(a.sum())
    assert np.isclose(hmm.log_likelihoods(obs, starts, m)[1], total, rtol=1e-12)
    first, moves, emits = hmm.expected_counts(obs, starts, m)
    assert np.isclose(first.sum(), 2) and np.isclose(moves.sum(), 29_998) and np.allclose(emits.sum(axis=0), np.bincount(obs, minlength=51))


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def reference(rows, train, states, classes, rounds):
    """Rows of the query by plain counts and one text at a time."""
    cls = lambda w: xxhash.xxh3_128_intdigest(w) // 2**64 % classes
    counts = Counter(w for (i, t), k in zip(rows, train) if k for w in words_of(t))
    ends = sum(train)
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    uses, distinct = Counter(), Counter()
    for w, c in counts.items():
        uses[cls(w)] += c
        distinct[cls(w)] += 1
    obs = [np.array([cls(w) for w in words_of(t)] + [classes], np.int64) for _, t in rows]
    m = hmm.Model.begin(states, classes)
    for _ in range(rounds if ends else 0):
        parts = [hmm.expected_counts(o, np.array([0, len(o)]), m) for o, k in zip(obs, train) if k]
        m = hmm.Model.of_counts(*(sum(p[i] for p in parts) for i in range(3)))
    out = []
    for (i, t), k, o in zip(rows, train, obs):
        ws = words_of(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        share = sum(math.log10((counts[w] + 0.1) / (uses[cls(w)] + 0.1 * (distinct[cls(w)] + 1))) for w in ws)
        a, total = m.first * m.emit[:, o[0]], 0.0
        for x in o[1:]:
            total, a = total + math.log10(a.sum()), (a / a.sum()) @ m.move * m.emit[:, x]
        out.append((-1 if i is None else i, not k, len(o), sum(counts[w] > 0 for w in ws) + (ends > 0), n, base, total + math.log10(a.sum()) + share))
    return sorted(out)


def some_rows():
    rng = random.Random(6)
    two = (["the", "The", "cat", "sat", "on", "mat", "and"], ["der", "Hund", "liegt", "im", "Hof", "und", "Über"])
    rows = [(i, " ".join(rng.choice(two[i % 2]) for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, " \t\n\x0b"), (503, "cat " * 5000), (None, "the cat"), (7, rows[7][1]), (504, "\u00a0unseen\u00a0word")]


def test_scores_equal_the_plain_reference(spark, docs_of):
    rows = some_rows()
    docs = docs_of(rows).withColumnRenamed("lang", "train").repartition(3)
    train = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    for made, k in ((hmm.score_texts(docs, ~hmm.held_out(F.col("doc_id")), states=2, classes=64), train),
                    (hmm.score_texts(docs, F.lit(False), states=2, classes=64), [False] * len(rows))):
        got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in made.collect())
        want = reference(rows, k, 2, 64, 3)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5, atol=1e-4)


def test_learns_more_than_unigrams(spark, docs_of):
    rows = [r for r in some_rows()[:120]]
    made = hmm.score_texts(docs_of(rows), ~hmm.held_out(F.col("doc_id")), states=2, classes=256, rounds=6).where("held_out").collect()
    assert made and sum(r.score for r in made) > sum(r.base_score for r in made) + 0.1 * sum(r.n_tokens for r in made)


def test_shares_of_a_class_add_to_one(spark, docs_of):
    # with one state and one class the model is: words or end, then the word's share of all words
    made = hmm.score_texts(docs_of([(1, "a a b"), (2, "c")]), F.col("doc_id") == 1, states=1, classes=1, rounds=1).orderBy("doc_id").collect()
    word, end = (3 + 0.01) / 4.02, 1.01 / 4.02
    assert np.isclose(made[0].score, math.log10(word**3 * end * (2.1 / 3.3) ** 2 * 1.1 / 3.3), atol=1e-4)
    assert np.isclose(made[1].score, math.log10(word * end * 0.1 / 3.3), atol=1e-4)


def test_empty_table(spark, docs_of):
    assert hmm.score_texts(docs_of([]), F.lit(True)).count() == 0
