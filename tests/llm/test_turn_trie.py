"""Prefix trie by list-ranked Euler tours against a plain tree."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from storewatch.llm import turn_trie
from storewatch.session import Scope

SCHEMA = "conv_id long, turn long, role string, text string, depth int, up string"


def reference(rows, borrow):
    """Per node: (conv, depth, parent, members, children, leaves, saved, digest)."""
    md5 = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", md5(text), text or ""))
    convs = {c: [(r, x) for _, r, _, x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if borrow else 0
        first = convs.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        built[c] = (first[:h] if borrow else []) + own[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        kids = children.get(k, [])
        out[k] = (sum(out[x][0] for x in kids) if kids else 1,
                  sum(out[x][1] for x in kids) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0))
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if len(built[c]) == len(k)).encode()).hexdigest()
    return sorted((min(m), len(k), str(min(members[k[:-1]])) if k else "", len(m), len(children.get(k, [])), *out[k], sha(k)) for k, m in members.items())


def got(nodes):
    rows = nodes.collect()
    inside = {(r.conv_id, r.depth): (r.enter, r["exit"]) for r in rows}
    assert sorted(x for e in inside.values() for x in e) == list(range(2 * len(rows)))
    for r in rows:
        if r.depth:
            enter, leave = inside[(r.parent_conv_id, r.depth - 1)]
            assert enter < r.enter < r["exit"] < leave
    return sorted((r.conv_id, r.depth, "" if r.parent_conv_id is None else str(r.parent_conv_id), r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in rows)


def some_rows(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        c = rng.choice([c, c * 7, 100 * (c % 5), -c])
        for t in range(rng.choice([0, 1, 1, 2, 3, 7])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None, ""]), rng.choice(["a", "a", "a", "bé", None, "", "ccc"]), 1, "x"))
    rows += [(None, 0, "user", "nobody", 1, "x")] * 3
    rows += [(700, t, "user", f"long {t % 3}", 1, "x") for t in range(120)]                            # a third of all rows
    rows += [(1000 + i, t, "user", "same", 1, "x") for i in range(40) for t in range(6)]               # copies
    return rows


@pytest.mark.parametrize("borrow", [True, False])
def test_against_a_plain_tree(spark, borrow):
    rows = some_rows(3)
    made = turn_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), borrow=borrow)
    assert got(made) == reference(rows, borrow)


def test_many_rounds_of_contraction(spark):
    rows = some_rows(8, 25)
    made = turn_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), borrow=True, base=12, share=9)
    assert got(made) == reference(rows, True)


def test_empty_and_lone(spark):
    assert turn_trie.prefix_trie(spark.createDataFrame([], SCHEMA), borrow=True).count() == 0
    assert turn_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x")], SCHEMA)).count() == 0
    rows = [(5, 0, "user", "hi", 1, "x")]
    assert got(turn_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), borrow=True)) == reference(rows, True)


def test_running_sums_cross_partitions(spark):
    rng = random.Random(1)
    rows = [(c, i, rng.choice([5, 2**62, -3])) for c, n in ((1, 3), (2, 400), (3, 1), (9, 150), (10, 2)) for i in range(n)]
    with Scope(spark) as scope:
        df = spark.createDataFrame(rows, "conv long, i long, v long").repartition(7)
        out = turn_trie.running_sums(df, ["i"], ["v"], 16, scope).collect()
    total = {}
    for r in sorted(out, key=lambda r: (r.conv, r.i)):
        wrap = lambda x: (x + 2**63) % 2**64 - 2**63
        assert r.v_old == total.get(r.conv, 0)
        total[r.conv] = wrap(total.get(r.conv, 0) + r.v)
        assert r.v_run == total[r.conv]
    assert len(out) == len(rows)


def test_contract_is_a_list_rank():
    rng = np.random.default_rng(5)
    order = rng.permutation(500)
    ids = np.stack([order // 7, order], axis=1).astype(np.int64)
    after = np.roll(ids, -1, axis=0)
    known = np.arange(500) < 499
    shuffle = rng.permutation(500)
    weights = rng.integers(0, 9, (500, 2))
    jump, before, last = turn_trie.contract(ids[shuffle], after[shuffle], known[shuffle], weights[shuffle])
    run = np.cumsum(weights, axis=0) - weights
    assert (before == run[shuffle]).all() and len(last) == 1 and (shuffle[jump] == 0).all()
