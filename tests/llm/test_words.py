"""Word splitting and rolling hashes against plain Python."""
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from storewatch.llm.words import inside, ngram_hash, row_slices, split_words, word_hashes

TEXT = st.one_of(st.none(), st.text(alphabet="abA é\u00a0\t\n\x0b\x0c\r\x1c日", max_size=40))


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_words_and_hashes(texts):
    col = pa.array(texts, pa.string())
    want = [(t or "").encode().split() for t in texts]
    got = split_words(col)
    vocab = got.vocab.to_pylist()
    assert [[vocab[c] for c in got.codes[a:b]] for a, b in zip(got.starts[:-1], got.starts[1:])] == want
    (h, g), starts = word_hashes(col, 2)
    flat = [w for ws in want for w in ws]
    assert starts.tolist() == got.starts.tolist()
    assert len({(w, a, b) for w, a, b in zip(flat, h.tolist(), g.tolist())}) == len(set(flat))
    grams = {}
    hashes = ngram_hash(h, 3, 0)
    at, row = inside(starts, 3)
    assert len(at) == sum(max(0, len(w) - 2) for w in want)
    for p, _ in zip(at, row):
        assert grams.setdefault(tuple(flat[p:p + 3]), hashes[p]) == hashes[p]
    assert len(set(grams.values())) == len(grams)


def test_slices_cover_all_rows_and_lowercase_is_ascii_only():
    col = pa.array(["a" * 10, None, "b" * 50, "", "c"])
    cuts = list(row_slices(col, 20))
    assert [i for lo, hi in cuts for i in range(lo, hi)] == list(range(5))
    assert split_words(pa.array(["ABÉ z"]), lower=True).vocab.to_pylist() == ["abÉ".encode(), b"z"]
    long = "x" * 5000
    (h,), _ = word_hashes(pa.array([f"{long}a {long}b {long}a"]))
    assert h[0] == h[2] != h[1]
    assert np.array_equal(word_hashes(pa.array(["Ab"]), 1, True)[0][0], word_hashes(pa.array(["ab"]))[0][0])
