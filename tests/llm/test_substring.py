"""Repeated passages against brute force over all windows."""
import random

import pytest

from conftest import split_words
from storewatch.llm import substring


def brute(rows, width):
    first = {}
    big = 2**63 - 1
    words = [split_words(r[1]) for r in rows]
    for r, w in zip(rows, words):
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            first[key] = min(first.get(key, big), big if r[0] is None else r[0])
    out = []
    for r, w in zip(rows, words):
        own = big if r[0] is None else r[0]
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < own:
                gone[i:i + width] = [True] * width
        out.append((r[0], len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def make_rows(seed, width):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["é", "日本"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(width), text(width + 5), text(3 * width), text(width - 1)]
    rows = [(None, None), (0, ""), (1, "  \n "), (2, text(3 * width)), (2, text(3 * width))]
    for i in range(3, 40):
        parts = [text(rng.randrange(0, 2 * width))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages), text(rng.randrange(0, width))]
        rows.append((rng.randrange(1000), rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(5000 + i, rows[7][1]) for i in range(5)]                  # copies
    rows += [(6000, rows[8][1]), (6000, rows[8][1])]                    # repeated rows
    rows += [(None, rows[9][1]), (7000, text(30_000) + " " + passages[2])]  # no id; very long
    rows += [(8000, "a " * 200), (8001, "a " * 50)]                     # one word over and over
    return rows


@pytest.mark.parametrize("width", [2, 13, 50])
def test_matches_brute_force(spark, docs_of, width):
    rows = make_rows(width, width)
    done = substring.remove_repeats(docs_of(rows), min_words=width).collect()
    got = sorted([(r.doc_id, r.repeats.n_words, r.repeats.n_removed, b" ".join(split_words(r.text)).decode()) for r in done], key=str)
    assert got == brute(rows, width)
    for r in done:
        assert sum(s.end - s.start for s in r.repeats.spans) == r.repeats.n_removed
        assert all(s.end - s.start >= width for s in r.repeats.spans)


def test_untouched_text_other_columns_and_empty_table(spark):
    schema = "repeats string, text string, id long, spans int, doc_id long"
    df = spark.createDataFrame([("x", " keep \n this\t", 4, None, 1), (None, "a", None, 2, 2)], schema)
    done = substring.remove_repeats(df.drop("repeats"), min_words=13)
    assert done.columns == ["text", "id", "spans", "doc_id", "repeats"]
    assert {(r.text, r.id, r.spans, r.doc_id) for r in done.collect()} == {(" keep \n this\t", 4, None, 1), ("a", None, 2, 2)}
    assert substring.remove_repeats(df.limit(0).drop("repeats")).count() == 0
