"""The packed token ids are part of the results, and the digests are theirs."""
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from storewatch.llm import packing
from storewatch.llm.tokens import token_ids

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_pipeline_keeps_the_packed_ids(spark, docs_of):
    texts = {i: f"some words {i} " * (i % 40) for i in range(60)} | {100: "long " * 5000, 101: None}
    last = corpus_pipeline.packed(spark, docs_of(list(texts.items())), "").cache()
    rows = packing.with_arrays(last).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        got.setdefault(r.doc_id, []).extend(r.ids)
    ids, off = token_ids(pa.array(list(texts.values())), WORD, 0)
    assert got == {i: ids[a:b].tolist() for i, a, b in zip(texts, off[:-1], off[1:])}
    whole = {r.sequence_id: r.ids for r in packing.sequences(last).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == r.ids
    assert max(map(len, whole.values())) <= 2048


def test_digests_follow_the_ids(docs_of):
    made = packing.pack(docs_of([(i, f"a few words {i} " * (i % 9)) for i in range(50)]), WORD, 64, with_ids=True)
    plain = packing.digests(made)
    assert plain.columns == [c for c in made.columns if c != "ids"]
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, made.drop("ids").collect()))
    other = packing.digests(made.withColumns({"ids": F.lit(np.array([7, 8], "<u2").tobytes()), "length": F.lit(2).cast("long")})).collect()
    assert {(r.length, r.ids_crc32) for r in other} == {(2, zlib.crc32(np.array([7, 8], "<u4").tobytes()))}
