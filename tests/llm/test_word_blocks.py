"""Words are hashed a block at a time: a worker's memory follows the block, the hashes do not."""
import numpy as np
import pyarrow as pa

from storewatch.llm import packed
from storewatch.llm.words import _run_hash, _spans, _word_blocks, mix, word_hashes


def test_blocks_hold_every_word_once_and_are_small():
    spans = np.concatenate([[0], np.cumsum([3, 5, 4000, 1, 1, 2, 700, 800, 900])])
    blocks = list(_word_blocks(spans, 1000))
    assert [i for b in blocks for i in range(b.start, b.stop)] == list(range(9))
    assert all(b.stop - b.start == 1 or spans[b.stop] - spans[b.start] <= 1000 for b in blocks)
    assert list(_word_blocks(np.zeros(1, np.int64))) == []


def test_hashes_are_those_of_the_whole():
    col = pa.array(["aa b " * 40_000, None, "", "ccc " + "d" * 200 + " e"])
    raw = "".join(x or "" for x in col.to_pylist()).encode()
    off = np.concatenate([[0], np.cumsum([len(x or "") for x in col.to_pylist()])])
    text, spans, starts = _spans(np.frombuffer(raw, np.uint8), off)
    whole = mix(_run_hash(text.astype(np.uint64) + np.uint64(1), spans[:-1], spans[1:], 0) ^ np.diff(spans).astype(np.uint64))
    (got,), at = word_hashes(col)
    assert np.array_equal(got, whole) and np.array_equal(at, starts)


def test_packed_rows_are_copied_a_few_at_a_time():
    batch = pa.RecordBatch.from_pylist([{"bucket": i, "a": b"x" * i} for i in range(150)])
    assert list(packed.rows_of(iter([batch]), 64)) == batch.to_pylist()
