"""Copies of one text must not meet in one bucket or task."""
import numpy as np
from pyspark.sql import functions as F

from storewatch.llm import packed, substring


def copies(n, values=64):
    """Entries of ``n`` documents that share a text: one key, ids of their own."""
    ids = np.repeat(np.arange(n, dtype=np.int64), values)
    return ids, np.full(len(ids), 12345, np.int64), np.tile(np.arange(values, dtype=np.uint64), n)


def rows_of_copies(n, parts, kind=1, **more):
    out = packed.Outbox(parts, **more)
    return [*out.add(kind, *copies(n)), *out.flush()]


def test_copies_of_a_text_spread_over_buckets():
    held = {}
    for row in rows_of_copies(4000, 8):
        held[row["bucket"]] = held.get(row["bucket"], 0) + len(packed.ids_of(row)[2])
    assert sum(held.values()) == 4000 * 64
    assert max(held.values()) < 4 * 4000 * 64 / packed.doc_buckets(8)


def test_regroup_deals_copies_to_all_tasks_and_keeps_every_entry(spark):
    frame = spark.createDataFrame(rows_of_copies(2000, 8) + rows_of_copies(1000, 8, kind=0, limit=5000), packed.SCHEMA)
    done = packed.regroup(frame, (0, 1), 8).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.id for r in done) == list(range(2000))
    whole = np.arange(64, dtype="<u8").tobytes()
    assert all(r.key == 12345 and bytes(r.k1) == whole and bytes(r.k0) == (whole if r.id < 1000 else b"") for r in done)
    per_task = np.unique([r.task for r in done], return_counts=True)[1]
    assert len(per_task) == 8 and per_task.max() < 2000 / 2


def test_repeated_rows_send_their_entries_once():
    out = packed.Outbox(4)
    for _ in range(50):
        assert not list(out.add(1, *copies(3)))
    assert sum(len(packed.ids_of(r)[2]) for r in out.flush()) == 3 * 64


def test_large_group_of_copies(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text) for i in range(400)] + [(None, text)] * 100 + [(1000 + i, f"own{i} " * 3) for i in range(20)]
    done = substring.remove_repeats(docs_of(rows), min_words=13).collect()
    assert len(done) == len(rows)
    assert {r.doc_id for r in done if r.repeats.n_removed == 0} == {0, *range(1000, 1020)}
    assert all(r.repeats.n_removed == 60 for r in done if r.doc_id is None or 0 < r.doc_id < 1000)
