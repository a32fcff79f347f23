"""Water-filling and seeded repetition."""
from collections import defaultdict

from storewatch.llm import source_mix


def fill(sizes, weights, cap):
    """Iterative clamping: the plain definition."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        if not rest:
            return fixed
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(cap * sizes[s]) for s in over}


def test_plan(spark, docs_of):
    rows = [(None, None, None), (1, "", "b"), (2, " \n", "é")]
    for i in range(400):
        rows.append((i, "w " * (i % 37 + 1), ["a", "b", "B", "é", None, "big"][i % 6 if i % 3 else 5]))
    rows += [(900 + i, "tiny", "z-small") for i in range(2)]
    rows += [(7, "same row", "a")] * 3 + [(8, "long " * 30_000, "big")]
    df = docs_of(rows).selectExpr("*", "1 as size", "'x' as target", "2 as taken", "3 as copies")
    got = source_mix.mix_plan(df, keep=("source",)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = fill(dict(sizes), (5, 2, 1), 3), defaultdict(int)
    assert len(got) == len(rows)
    largest = defaultdict(int)
    for r in got:
        values = dict(zip(r.__fields__[:6], r[:6]))
        source = r[6]
        assert values["source_size"] == sizes[source] and abs(values["target"] - want[source]) < 1e-6
        assert values["taken"] == values["size"] * values["copies"] <= 3 * values["size"]
        taken[source] += values["taken"]
        largest[source] = max(largest[source], values["size"])
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s] / 2 + 1
    again = source_mix.mix_plan(df).collect()
    assert sorted(map(str, (r[:6] for r in got))) == sorted(map(str, (r[:6] for r in again)))


def test_mix_repeats_rows(spark, docs_of):
    df = docs_of([(i, "word " * (i + 1), "ab"[i % 2]) for i in range(20)] + [(3, None, None)])
    plan = {}
    for r in source_mix.mix_plan(df).collect():
        plan[r.doc_id, r.size] = r.copies
    out = source_mix.mix(df)
    assert out.columns == df.columns
    count = defaultdict(int)
    for r in out.collect():
        count[r.doc_id, len((r.text or "").split())] += 1
    assert dict(count) == {k: v for k, v in plan.items() if v}


def test_empty(spark, docs_of):
    assert source_mix.mix_plan(docs_of([])).count() == 0
    r = source_mix.mix_plan(docs_of([(1, None, None)])).first()
    assert (r.size, r.target, r.taken) == (0, 0.0, 0)
