"""Packed rows: many (document, values) entries of one bucket in a single row of binary columns.

Per-word work would cost a Spark row per word; a packed row carries up to ``CHUNK`` entries as numpy
buffers, at a few bytes each, while Spark still partitions, shuffles and spills the rows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from storewatch.llm.words import mix

CHUNK = 1 << 16
TEXT_A_PARTITION = 4 << 20
SCHEMA = "bucket int, kind int, ids binary, keys binary, doc binary, a binary, b binary, c binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32())]
                   + [(n, pa.binary()) for n in ("ids", "keys", "doc", "a", "b", "c")])


def limit_batches(spark: SparkSession, limit: str = "4m") -> None:
    """Bound the bytes of an Arrow batch unless the session already does: 10,000 long texts do not fit a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "-1", str(2**31 - 1), str(2**63 - 1)):
        spark.conf.set(name, limit)


def partitions(spark: SparkSession, size: int | None = None) -> int:
    """Shuffle partitions of the session, which a job sizes to its data; fewer (one a core at least) where ``size`` bytes of text would leave
    less than ``TEXT_A_PARTITION`` to each: every task packs rows for every other, so their number would follow the square of the tasks'."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return n if size is None else min(n, max(spark.sparkContext.defaultParallelism, -(-size // TEXT_A_PARTITION)))


def pack_entries(bucket: np.ndarray, kind: int, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray,
                 a: np.ndarray | None = None, b: np.ndarray | None = None, c: np.ndarray | None = None) -> Iterator[dict]:
    """Rows of the entries, one or more per bucket; ``doc`` indexes ``ids`` and ``keys``."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, doc = bucket[order], doc[order]
    values = [None if v is None else v[order] for v in (a, b, c)]
    edges = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)), [len(bucket)]])
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        for at in range(int(lo), int(hi), CHUNK):
            part = slice(at, min(at + CHUNK, int(hi)))
            used, local = np.unique(doc[part], return_inverse=True)
            yield {"bucket": int(bucket[at]), "kind": kind, "ids": ids[used].astype("<i8").tobytes(),
                   "keys": keys[used].astype("<i8").tobytes(), "doc": local.astype("<u2").tobytes(),
                   **{n: None if v is None else np.ascontiguousarray(v[part]).tobytes()
                      for n, v in zip("abc", values, strict=True)}}


def doc_buckets(parts: int) -> int:
    """Buckets that documents are dealt to: several a partition, but few enough that a full outbox makes rows of 128 entries."""
    return max(parts, min(16 * parts, 1 << 13))


class Outbox:
    """Collects (id, key, value) entries for documents and packs them by document bucket, many at a time.

    Rows then follow the number of entries, not the number of packed rows that they came from.  The bucket mixes id
    and key, so copies of a text spread over all buckets; equal entries (of repeated rows) are packed once."""

    def __init__(self, parts: int, limit: int = 1 << 20):
        self.buckets, self.limit, self.held, self.size = doc_buckets(parts), limit, [], 0

    def add(self, kind: int, ids: np.ndarray, keys: np.ndarray, values: np.ndarray) -> Iterator[dict]:
        if len(ids):
            self.held.append((np.full(len(ids), kind, np.int8), ids, keys, values))
            self.size += len(ids)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[dict]:
        if not self.held:
            return
        kind, ids, keys, values = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        bucket = (mix(keys.astype(np.uint64) ^ mix(ids.astype(np.uint64))) % np.uint64(self.buckets)).astype(np.int64)
        kind, bucket, ids, keys, values = _distinct(kind, bucket, ids, keys, values)
        cut = (np.diff(bucket) != 0) | (np.diff(kind) != 0)
        edges = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(ids)]])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            for at in range(int(lo), int(hi), CHUNK):
                part = slice(at, min(at + CHUNK, int(hi)))
                new = np.ones(part.stop - at, bool)
                new[1:] = (np.diff(ids[part]) != 0) | (np.diff(keys[part]) != 0)
                yield {"bucket": int(bucket[at]), "kind": int(kind[at]), "ids": ids[part][new].astype("<i8").tobytes(),
                       "keys": keys[part][new].astype("<i8").tobytes(), "doc": (np.cumsum(new) - 1).astype("<u2").tobytes(),
                       "a": np.ascontiguousarray(values[part], "<u8").tobytes(), "b": None, "c": None}


def batches_of(rows: Iterator[dict], limit: int = 4 << 20, schema: pa.Schema = _ARROW) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch], at_once: int = 64) -> Iterator[dict]:
    """Rows of the batches, ``at_once`` of them copied at a time."""
    pa.default_memory_pool().release_unused()  # what an earlier stage left with this worker
    for batch in batches:
        for lo in range(0, batch.num_rows, at_once):
            yield from batch.slice(lo, at_once).to_pylist()


def ids_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, keys and per-entry index of a packed row."""
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["doc"], "<u2")


def _distinct(*cols: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows of the columns, sorted by them."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return tuple(c[new] for c in cols)


def regroup(packed: DataFrame, kinds: tuple[int, ...], parts: int) -> DataFrame:
    """Entries per document: id, key and for each kind a binary column ``k<kind>`` of its distinct 64-bit values ``a``.

    Buckets must be a function of (id, key).  A task streams its buckets in order and holds the entries of one: a share
    of 1 / :func:`doc_buckets` of all documents, copies of a text among them."""
    names = [f"k{k}" for k in kinds]
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64())] + [(n, pa.binary()) for n in names])

    def docs(found: list[tuple[np.ndarray, ...]]) -> Iterator[dict]:
        ids, keys, kind, value = _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
        found.clear()
        cut = (np.diff(ids) != 0) | (np.diff(keys) != 0)
        edges = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(ids)]])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = lo + np.searchsorted(kind[lo:hi], kinds), lo + np.searchsorted(kind[lo:hi], kinds, side="right")
            yield {"id": int(ids[lo]), "key": int(keys[lo]),
                   **{n: value[a:b].tobytes() for n, a, b in zip(names, *part, strict=True)}}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[dict]:
            bucket, found = None, []
            for row in rows_of(batches):
                if row["bucket"] != bucket and found:
                    yield from docs(found)
                bucket = row["bucket"]
                ids, keys, doc = ids_of(row)
                found.append((ids[doc], keys[doc], np.full(len(doc), row["kind"], np.int8), np.frombuffer(row["a"], "<u8")))
            if found:
                yield from docs(found)

        yield from batches_of(entries(), schema=schema)

    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(
        gather, "id long, key long, " + ", ".join(f"{n} binary" for n in names))
