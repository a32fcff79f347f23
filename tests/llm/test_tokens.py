"""Token ids, bit-packed files and packing against the tokenizer itself and brute force."""
import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from storewatch.llm import packing, token_file, tokens
from storewatch.llm.tokens import token_ids
from storewatch.session import cut_lineage, new_folder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = ["", "  ", " a  b\n\n c\t", "don't 's  x", "é　 a \xa0 b", None, "a<|endoftext|> b", "tab\t\t \n", "x\x1c  y", "Σας ΑΣ",
         "e ́a", "日本 語  テスト", "  z", "w" * 5000, "12 345.6\r\n", "a  <|endoftext|>  b", "<|endoftext|><|startoftext|> x", "a <|endoftext|", "x <|ENDOFTEXT|> y", "It's a-b, don't.Stop'S (ok)!? a= b"]


def direct(path, texts, literal=False):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = literal
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_direct_encoding(path):
    col = pa.array(TEXTS)
    for literal in (True, False):
        ids, off = token_ids(col, path, literal=literal)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == direct(path, TEXTS, literal)
    want = direct(path, TEXTS)
    ids, off = token_ids(col, path)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want
    ids, off = token_ids(col.slice(1), path, 0)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [w + [0] for w in want[1:]]
    assert token_ids(pa.array([], pa.string()), path)[1].tolist() == [0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab ' \t\n\r\x0b\x1f é.1", max_size=25), max_size=5))
def test_chunks_never_change_ids(texts):
    for path in (BYTE, WORD):
        ids, off = token_ids(pa.array(texts, pa.string()), path)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == direct(path, texts)


def test_memory_of_chunks_is_bounded_and_right(monkeypatch):
    monkeypatch.setattr(tokens, "_MEMO_CHUNKS", 40)
    monkeypatch.setattr(tokens, "_AT_ONCE", 7)
    tokens._load.cache_clear()
    try:
        for i in range(5):
            texts = [" ".join(f"word{(i * 7 + j) % 60} é{j}" for j in range(30)) for _ in range(3)]
            ids, off = token_ids(pa.array(texts), BYTE, 0)
            assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [x + [0] for x in direct(BYTE, texts)]
        memo = tokens._load(BYTE, False)[1]
        assert 40 <= len(memo.name) < 130 and (np.diff(memo.name[:, 0].astype(float)) >= 0).all()
    finally:
        tokens._load.cache_clear()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 2**32 - 1))
def test_pack_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    raw = token_file.pack(ids, bits)
    assert len(raw) == -(-n // 64) * bits * 8
    assert token_file.unpack(raw, bits, n).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        token_file.pack(np.array([1 << bits], np.uint64), bits)


def test_bits():
    assert [token_file.bits_for(v) for v in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_files(spark, docs_of):
    rows = [(i, f"text number {i} " * (i % 50)) for i in range(300)] + [(7, "again"), (7, "again"), (None, "no id"), (500, None)]
    rows += [(i + 1000, t) for i, t in enumerate(TEXTS)] + [(2000, "long text " * 20_000)]
    df = docs_of(rows[::-1]).selectExpr("*", "1 as start", "2 as ids")
    manifest = cut_lineage(token_file.write_tokens(df, new_folder(spark, "tok"), BYTE, file_ids=5_000, slice_bytes=4_000))
    assert manifest.count() > 4
    want, at = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for (i, _), ids in zip(order, direct(BYTE, [r[1] for r in order])):
        ids = ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = [tuple(r) for r in token_file.read_tokens(manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_file.read_tokens(manifest, digest_only=True).filter("ids is not null").count() == 0
    one = manifest.orderBy("part", "seq").first()
    from storewatch.llm.files import open_input
    raw = open_input(one.path).read()
    file = token_file.TokenFile(pa.BufferReader(raw))
    assert file.document(2).tolist() == want[2][4]
    everything = file.ids(0, file.n_ids)
    for lo, hi in ((0, 1), (4095, 4097), (file.n_ids - 3, file.n_ids), (10, 10)):
        assert file.ids(lo, hi).tolist() == everything[lo:hi].tolist()
    with pytest.raises(IndexError):
        file.ids(0, file.n_ids + 1)
    for bad in (raw[:-1], raw[1:], b"", b"x" * 100):
        with pytest.raises(ValueError):
            token_file.TokenFile(pa.BufferReader(bad))
    empty = cut_lineage(token_file.write_tokens(docs_of([]), new_folder(spark, "tok"), BYTE))
    assert token_file.read_tokens(empty).count() == 0
    assert io.BytesIO(raw).read(8) == token_file.MAGIC


def test_nnls_matches_projected_gradient():
    rng = np.random.default_rng(0)
    for _ in range(5):
        a, b = rng.random((12, 30)), rng.random(12) * 10
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-6 and abs(gain[x > 0]).max(initial=0) < 1e-6


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(0, 60)), max_size=12))
def test_plan_holds_every_piece(pairs):
    histogram = np.zeros(65, np.int64)
    for n, k in pairs:
        histogram[n] += k
    got, used = np.zeros(65, np.int64), 0
    for n, content in packing.plan(histogram, 64, classes=8):
        assert n > 0 and 0 < sum(length * k for length, k in content) <= 64
        for length, k in content:
            got[length] += n * k
        used += n
    assert (got == histogram).all()
    rooms = []                                                   # first fit, longest first
    for length in np.repeat(np.arange(65), histogram)[::-1]:
        fit = next((i for i, r in enumerate(rooms) if r >= length), None)
        if fit is None:
            rooms.append(64 - length)
        else:
            rooms[fit] -= length
    assert used <= 1.1 * len(rooms) + 1


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(6, 1, 100_000), 1, 2048).astype(int)
    histogram = np.bincount(lengths, minlength=2049)
    sequences = sum(n for n, _ in packing.plan(histogram, 2048))
    assert sequences <= 1.002 * -(-int(lengths.sum()) // 2048)


def test_pack(spark, docs_of):
    rows = [(i, f"some words {i} " * (i * 7 % 60)) for i in range(300)] + [(None, None), (5, ""), (5, ""), (900, "long " * 5000)]
    df = docs_of(rows).selectExpr("*", "1 as piece", "2 as length", "3 as offset")
    packed = packing.pack(df, WORD, capacity=256, with_ids=True)
    got = packing.with_arrays(packed).collect()
    assert {len(r.ids) / r.length for r in packed.collect()} == {2.0}
    want = {}
    for (i, _), ids in zip(rows, direct(WORD, [r[1] for r in rows])):
        ids = ids + [0]
        for p, lo in enumerate(range(0, len(ids), 256)):
            part = ids[lo:lo + 256]
            key = (i, p, lo, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part))
            want[key] = want.get(key, 0) + 1
    have, places = {}, {}
    for r in got:
        key = (*r[:5], tuple(r.ids))
        have[key] = have.get(key, 0) + 1
        places.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    assert have == want
    for parts in places.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(places) <= 1.03 * -(-total // 256) + 1
    joined = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert joined == {k: [x for p in sorted(v) for x in p[2]] for k, v in places.items()}
    assert packing.pack(docs_of([]), WORD, capacity=256).count() == 0
