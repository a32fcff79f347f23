"""Links and components against all cosines; recall of the calibrated count."""
import numpy as np

from storewatch.llm import near_vectors as N
from storewatch.llm.graph import components
from storewatch.session import Scope


def brute(rows, threshold):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v)
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = {i: set() for i, _ in ok}
    count = {i: 0 for i, _ in ok}
    for a, (i, v) in enumerate(ok):
        for b, (j, w) in enumerate(ok):
            if a != b and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                link[i].add(j)
                count[i] += 1
    comp = {}
    for i in sorted(link):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += link[x]
    out = []
    for i, _ in rows:
        c = comp.get(i, i)
        out.append((i, count.get(i, 0), c, i is not None and i == c))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        base = rng.standard_normal(32)
        rows.append((i, base.tolist()))
        if i % 3 == 0:
            rows += [(1000 + 10 * i + k, (base + 0.12 * rng.standard_normal(32)).tolist()) for k in range(3)]
        if i % 20 == 0:
            rows += [(9000 + 10 * i + k, base.tolist()) for k in range(4)]
    rows += [(50_000, [0.0] * 32), (50_001, None), (50_002, [float("nan")] * 32), (50_003, [None] * 32), (50_004, []),
             (50_005, [1.0, 2.0]), (50_006, [2.0, 4.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, kept string")
    got = N.near_vectors(df, threshold=0.9, strip_rows=256).collect()
    want = brute(rows, 0.9)
    assert len(got) == len(rows)
    linked = sum(w[1] for w in want)
    assert sum(r.n_links for r in got) >= 0.99 * linked > 0     # recall is calibrated per pair
    assert sorted(map(tuple, got), key=str) == want


def test_recall_of_the_count():
    rng = np.random.default_rng(0)
    need = N.required_count(24, 2.5, 0.9999)
    line = N.directions(64, 24, 11)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((4000, 64))
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * side                       # pairs exactly at the threshold
    hits = (np.abs(x @ line - y @ line) <= 2.5 * N.distance(0.9)).sum(axis=1) >= need
    assert hits.mean() >= 0.99
    far = (np.abs(x @ line - np.roll(x, 1, axis=0) @ line) <= 2.5 * N.distance(0.9)).sum(axis=1) >= need
    assert far.mean() < 0.05


def test_empty(spark):
    assert N.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(200)] + [(7, 7), (5000, 4000), (4000, 5000)]
    edges += [(2000 + int(a), 2000 + int(b)) for a, b in rng.integers(0, 90, (60, 2))]
    link = {}
    for a, b in edges:
        link.setdefault(a, set()).add(b)
        link.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for i in sorted(link):
        todo = [i] if i not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                want[x] = i
                todo += link[x]
    with Scope(spark) as scope:
        df = spark.createDataFrame(edges, "a long, b long").repartition(7)
        got = {r.node: r.component for r in components(df, scope).collect()}
        assert got == {k: v for k, v in want.items() if k != v}
        assert components(df.limit(0), scope).count() == 0


def test_many_classes_at_one_place_lose_no_link(spark):
    """Vectors of one component all have the same direction: one strip, cut into parts."""
    rows = [(i, [1.0 + i / 7]) for i in range(300)] + [(1000 + i, [-2.0 - i]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in N.near_vectors(df, strip_rows=32).collect()}
    assert got == {i: (299, 0) if i < 1000 else (39, 1000) for i, _ in rows}


def test_pairs_at_the_threshold_do_not_depend_on_their_block(spark):
    """A pair within a rounding of the threshold is judged alike among many near vectors and among few."""
    import numpy as np
    rng = np.random.default_rng(3)
    a = rng.standard_normal(24)
    a /= np.linalg.norm(a)
    side = rng.standard_normal(24)
    side -= (side @ a) * a
    side /= np.linalg.norm(side)
    edge = [0.9 * a + np.sqrt(1 - 0.81) * side * (1 + k * 1e-16) for k in range(-6, 7)]
    pairs = [(i, v) for i, v in enumerate([a, *edge])]
    few = [(100 + i, rng.standard_normal(24)) for i in range(300)]
    many = [(100 + i, a + 0.01 * rng.standard_normal(24)) for i in range(300)]
    count = []
    for others in (few, many):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in pairs + others], "vec_id long, embedding array<double>")
        found = {r.vec_id: r.n_links for r in N.near_vectors(df).collect()}
        near = sum(1 for _, v in others if a @ v / np.linalg.norm(v) >= 0.9)
        count.append(found[0] - near)
    assert count[0] == count[1]
