"""Near-duplicate groups against all pairs of whole shingle sets."""
import random

import pytest

from storewatch.llm import jaccard


def sets_of(rows, n):
    out = []
    for r in rows:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (r[1] or "").encode())
        w = raw.split()
        out.append({tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)})
    return out


def brute(rows, n, num, den):
    sets = sets_of(rows, n)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or (a and b and den * len(a & b) >= num * len(a | b)):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def make_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choice(words) for _ in range(25))
    rows, at = [], 100
    for _ in range(25):
        size = rng.choice([3, 6, 12, 40, 120, 300])
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                text[rng.randrange(size)] = rng.choice(words)
            rows.append((at, " ".join(text) + (" " + common if rng.random() < 0.3 else "")))
            at += 1
    hub = [rng.choice(words) for _ in range(150)]                # a large group of near copies
    for _ in range(60):
        text = list(hub)
        text[rng.randrange(150)] = rng.choice(words)
        rows.append((at, "\n".join(text)))
        at += 1
    rows += [(at + i, rows[0][1].upper()) for i in range(10)]    # copies but for case
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "é É"), (8, "é É")]
    rows += [(9, rows[3][1]), (9, rows[3][1]), (None, rows[5][1]), (None, "only here without any id at all"), (None, None)]
    rows += [(10, " ".join(rng.choice(words) for _ in range(20_000)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_matches_brute_force(spark, docs_of, n, num):
    rows = make_rows(n)
    df = docs_of(rows).selectExpr("*", "'x' as component_id", "1 as n_shingles", "2 as row_key")
    got = jaccard.similar_groups(df, n=n, num=num, den=100).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, n, num, 100)


def test_long_lists_are_searched_in_blocks(spark, docs_of, monkeypatch):
    """One shingle sequence in a third of all documents, copies around two centres that few members link with directly."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    common = " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, f"{common} {' '.join(rng.choice(words) for _ in range(rng.choice([2, 3, 40])))}") for i in range(60)]
    centre = [rng.choice(words) for _ in range(120)]
    for i in range(80):
        text = list(centre)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            at = rng.randrange(118)
            text[at:at + 2] = [rng.choice(words), rng.choice(words)]
        rows.append((100 + i, " ".join(text)))
    rows += make_rows(7)[:60]
    rng.shuffle(rows)
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    want = brute(rows, 5, 80, 100)
    for short, query, node in ((1, 3, 5), (2, 500, 500), (10**6, 1, 1)):
        for name, value in (("SHORT_LIST", short), ("QUERY_BLOCK", query), ("NODE_BLOCK", node)):
            monkeypatch.setattr(jaccard, name, value)
        got = jaccard.similar_groups(docs_of(rows), n=5, num=80, den=100).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_empty(spark, docs_of):
    assert jaccard.similar_groups(docs_of([])).count() == 0
    assert [tuple(r)[:3] for r in jaccard.similar_groups(docs_of([(3, None)])).collect()] == [(3, 0, 3)]
