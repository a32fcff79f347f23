"""The corpus pipeline stage by stage against brute force, and the registered queries against DuckDB."""
import os
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from conftest import split_words
from storewatch.session import cut_lineage
from test_jaccard import sets_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory, docs_of):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "te", "zu") for b in ("ran", "lis", "dor", "pem", "tik", "vos", "nel")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    text = lambda k: "\n".join(line(rng.randrange(8, 16)) for _ in range(k))
    passage = line(60)
    rows, bad = [], set()
    for i in range(120):
        if i % 6 == 0:
            t, _ = "\n".join(line(10).replace(" ", "$$$ ### ") for _ in range(6)), bad.add(i)
        elif i % 10 == 1:
            t = rows[-2][1] if i > 2 and (i - 2) not in bad else text(8)
        elif i % 10 in (3, 7):
            t = text(4) + "\n" + passage + "\n" + text(3)
        else:
            t = text(rng.randrange(3, 12))
        rows.append((i, t, rng.choice(["a", "b", "c", None])))
    base = text(20).split(" ")
    for i in range(120, 140):
        new = list(base)
        new[rng.randrange(len(new))] = rng.choice(words)
        rows.append((i, " ".join(new), "big"))
    rows += [(200, None, "a"), (201, "", "a"), (5, rows[5][1], rows[5][2]), (None, text(6), "b"), (None, text(6), None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs_of(rows).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i not in bad), 0) for i in range(140)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, bad


def test_stages(spark, corpus):
    folder, rows, bad = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing sources", "best-fit packing"]

    kept = cut_lineage(stages["quality classifier"](spark, docs, folder))
    assert kept.columns == names
    one = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    clean = Counter((r[0], r[1]) for r in rows if r[1] and r[0] not in bad)
    assert not bad & {r[0] for r in one} and not clean - Counter((r[0], r[1]) for r in one)

    groups = cut_lineage(stages["n-gram Jaccard join"](spark, kept, folder))
    two = [(r.doc_id, r.text, r.source) for r in groups.collect()]
    sets = sets_of(one, 5)
    root = list(range(len(one)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if (one[i][0] is not None and one[i][0] == one[j][0]) or (a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j])):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(one):
        best[find(i)] = min(best.get(find(i), (10**10, "")), (10**9 if r[0] is None else r[0], r[1]))
    assert groups.columns == names
    assert sorted((10**9 if r[0] is None else r[0], r[1]) for r in two) == sorted(best.values())

    cut = cut_lineage(stages["substring dedup"](spark, groups, folder))
    from test_substring import brute as cut_brute
    want = [(w[0], w[3]) for w in cut_brute(two, 50) if w[1] == 0 or w[2] < w[1]]
    three = [(r.doc_id, r.text, r.source) for r in cut.collect()]
    assert cut.columns == names
    assert sorted((str(r[0]), b" ".join(split_words(r[1])).decode()) for r in three) == sorted((str(a), b) for a, b in want)
    assert cut.filter("n_chars <> length(text)").count() == 0

    mix = cut_lineage(stages["mixing sources"](spark, cut, folder))
    assert mix.columns == names
    from test_source_mix import fill
    sizes, taken, large = Counter(), Counter(), Counter()
    for _, t, s in three:
        sizes[s] += len(split_words(t))
        large[s] = max(large[s], len(split_words(t)))
    four = [(r.doc_id, r.text, r.source) for r in mix.collect()]
    for _, t, s in four:
        taken[s] += len(split_words(t))
    for s, target in fill(dict(sizes), (5, 2, 1), 3).items():
        assert abs(taken[s] - target) <= large[s] / 2 + 1
    assert max(Counter(four).values()) <= 3 * max(Counter(three).values())

    last = stages["best-fit packing"](spark, mix, folder).collect()
    assert Counter(r.doc_id for r in last if r.piece == 0) == Counter(r[0] for r in four)
    total = sum(r.length for r in last)
    assert len({r.sequence_id for r in last}) <= 1.02 * total / 2048 + 1


def test_run_and_empty_corpus(spark, corpus, tmp_path, docs_of):
    folder, _, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 60
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries_match_sql(spark):
    import __spark_entry__ as E
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    names = [n for n in E.queries() if n.startswith("op") and n[2].isdigit()]
    assert len(names) == 13 and "pipeline" in E.queries()
    for name in names:
        df = E.queries()[name](spark, SF)
        got = df.collect()
        assert got
        if name in E.oracle_sql():
            want = con.execute(E.oracle_sql()[name]).df()
            assert sorted(want.columns) == sorted(df.columns)
            cols = sorted(df.columns)
            norm = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
            a = sorted([tuple(str(norm(r[c])).removesuffix(".0") for c in cols) for r in got])
            b = sorted([tuple(str(norm(r[c])).removesuffix(".0") for c in cols) for r in want.to_dict("records")])
            assert a == b, name


def test_stages_carry_columns_of_any_name_and_type(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr(
        "*", "1 as repeats", "'q' as quality_of_text", "doc_id * 2 as _key", "'k' as _kept_0", "map('a', doc_id) as tags", "3 as _own", "4 as _place")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality classifier", "n-gram Jaccard join", "substring dedup", "mixing sources"):
        out = cut_lineage(stages[name](spark, docs, folder))
        assert out.columns == docs.columns and out.count() > 20
        for r in out.collect():
            assert (r.repeats, r.quality_of_text, r._key, r._kept_0, r._own) == (1, "q", r.doc_id * 2 if r.doc_id is not None else None, "k", 3)
            assert r.tags == {"a": r.doc_id}


def test_texts_that_share_an_id_are_documents_of_their_own(spark, docs_of):
    near = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "one text of its own with many words here"), (1, "quite another text that has nothing in common"), (2, near), (2, near), (3, near + " more"),
            (4, None), (4, ""), (5, "x"), (5, "x")]
    out = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs_of(rows), "").collect()
    assert sorted((r.doc_id, r.text or "") for r in out) == sorted([rows[0], rows[1], rows[2], (4, ""), (4, ""), (5, "x")])


def test_long_labelled_documents_are_learned_from(spark, docs_of):
    from storewatch.llm import quality
    rows = [(i, "Good line of words.\n" * 3000 if i % 2 else "$$$ ### !!!\n" * 3000) for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs_of(rows), labels)
    assert model.fitted
    got = quality.score_quality(docs_of(rows), model).collect()
    assert all(r.quality_of_text.predicted == r.doc_id % 2 for r in got)
    assert not quality.fit_quality(docs_of(rows), labels, max_train_chars=1000).fitted
