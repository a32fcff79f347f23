"""Removing repeated passages with fixed-block anchors.

A passage of at least ``min_words`` words that starts in a document with a smaller id is removed from
every later document, judged on the input.  Every run of W = ``min_words`` words contains a whole block of
B = (W + 1) // 2 words that starts at a multiple of B in its document, so:

1. *Index and probe.*  Each document's non-overlapping blocks are its reference blocks; every rolling
   window of B words probes them.  Blocks and probes meet by hash.  A probe hits if the block occurs in a
   document with a smaller id; the block's own document learns that a later one probes it.
2. *Extend.*  Around every hit the runs of W words that contain it are compared in full (128-bit hashes of
   the words): a run that a smaller document has too is repeated.  Hits that extend to W words on either
   side chain into the maximal exact repeats, the merged runs, whose spans are returned and cut out.

Block hashes only propose; a false proposal dies in the second step.

Scale: entries travel packed (a few bytes a word, see ``packed.py``).  A task meets its blocks in one
stream, references first: it keeps one smallest id per distinct reference hash and never a list of the
documents that share a block, so a passage in a third of all documents costs a longer stream but no
memory, and no pair of documents is ever formed.  Texts are shuffled by document only; they are joined
with the hits twice.  Everything can be recomputed after a lost executor; the hits are cut by written
tables.

Defined cases: null or empty texts have no words; documents shorter than W keep everything; documents
with equal ids do not remove from each other; a null id counts as the largest; repeated rows are treated
alike; an empty table gives an empty result; extra columns, also clashing ones, are carried unchanged.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storewatch.llm import packed
from storewatch.llm.words import _SPACE, _flat, inside, ngram_hash, row_slices, word_hashes
from storewatch.session import Scope, cut_lineage

SLICE = 2 << 20
REF, PROBE, REF_AGAIN = 0, 1, 2
_LOW = np.uint64(0xFFFFFFFF)


def _code(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper, remainder in the lower 32 bits."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & _LOW)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of (id, key, text, ...) batches of bounded text size."""
    pa.default_memory_pool().release_unused()  # what an earlier stage left with this worker
    for batch in batches:
        for lo, hi in row_slices(batch.column(2), SLICE):
            yield batch.slice(lo, hi - lo)


def _anchors(rows: DataFrame, block: int, min_words: int, buckets: int) -> DataFrame:
    """Packed reference blocks and rolling probes of every document with at least ``min_words`` words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[dict]:
            for part in _texts(batches):
                ids, keys = np.asarray(part.column(0)), np.asarray(part.column(1))
                (words,), starts = word_hashes(part.column(2))
                at, doc = inside(starts, block)
                long = np.diff(starts)[doc] >= min_words
                at, doc = at[long], doc[long]
                code = _code(ngram_hash(words, block, 0)[at] if len(at) else np.zeros(0, np.uint64), buckets)
                bucket, rest = (code >> np.uint64(32)).astype(np.int64), (code & _LOW).astype("<u4")
                own = (at - starts[doc]) % block == 0
                for kind in (REF, REF_AGAIN):
                    yield from packed.pack_entries(bucket[own], kind, ids, keys, doc[own], rest[own])
                yield from packed.pack_entries(bucket, PROBE, ids, keys, doc, rest)

        yield from packed.batches_of(entries())

    return rows.mapInArrow(emit, packed.SCHEMA)


def _streamed(frame: DataFrame, parts: int) -> DataFrame:
    return frame.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")


def _smallest(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys (one or two columns, sorted) and the smallest id of each."""
    *cols, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, *cols[::-1]))
    cols, ids = [c[order] for c in cols], ids[order]
    new = np.zeros(len(ids), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return *[c[new] for c in cols], ids[new]


def _probe(anchors: DataFrame, parts: int) -> DataFrame:
    """Hits, packed by document: kind PROBE (an earlier document has the block) and REF (a later one probes it)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[dict]:
            bucket, refs, table, out = None, [], None, packed.Outbox(parts)
            for row in packed.rows_of(batches):
                if row["bucket"] != bucket:
                    bucket, refs, table = row["bucket"], [], None
                ids, keys, doc = packed.ids_of(row)
                code = np.frombuffer(row["a"], "<u4")
                if row["kind"] == REF:
                    refs.append((code, ids[doc]))
                    if len(refs) >= 64:
                        refs = [_smallest(refs)]
                    continue
                if not refs:
                    continue
                if table is None:
                    known, low = _smallest(refs)
                    table = known, low, np.full(len(known), np.iinfo(np.int64).min)
                known, low, high = table
                place = np.minimum(np.searchsorted(known, code), len(known) - 1)
                same = known[place] == code
                mine = ids[doc]
                if row["kind"] == PROBE:
                    np.maximum.at(high, place[same], mine[same])
                    hit = same & (low[place] < mine)
                else:
                    hit = same & (high[place] > mine)
                full = code[hit].astype("<u8") | np.uint64(bucket << 32)
                yield from out.add(PROBE if row["kind"] == PROBE else REF, mine[hit], keys[doc[hit]], full)
            yield from out.flush()

        yield from packed.batches_of(entries())

    return _streamed(anchors, parts).mapInArrow(meet, packed.SCHEMA)


def _around(hits: np.ndarray, starts: np.ndarray, doc: np.ndarray, block: int, min_words: int, size: int) -> np.ndarray:
    """Mask of the word positions where a run of ``min_words`` words starts that contains a hit block."""
    mark = np.zeros(size + 1, np.int64)
    lo = np.maximum(hits - (min_words - block), starts[doc])
    hi = np.minimum(hits, starts[doc + 1] - min_words)
    ok = lo <= hi
    np.add.at(mark, lo[ok], 1)
    np.add.at(mark, hi[ok] + 1, -1)
    return np.cumsum(mark)[:size] > 0


def _extensions(rows: DataFrame, block: int, min_words: int, buckets: int) -> DataFrame:
    """Packed runs of ``min_words`` words around hits: REF where the document is the earlier one, PROBE the later."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[dict]:
            for part in _texts(batches):
                ids, keys = np.asarray(part.column(0)), np.asarray(part.column(1))
                lanes, starts = word_hashes(part.column(2), 2)
                size = len(lanes[0])
                at, doc = inside(starts, block)
                if not len(at):
                    continue
                code = _code(ngram_hash(lanes[0], block, 0)[at], buckets)
                runs = [ngram_hash(lane, min_words, i) for i, lane in enumerate(lanes)]
                own = (at - starts[doc]) % block == 0
                room = np.searchsorted(doc, np.arange(len(ids) + 1))
                hit = {REF: np.zeros(len(at), bool), PROBE: np.zeros(len(at), bool)}
                for i in range(len(ids)):
                    mine = slice(room[i], room[i + 1])
                    for kind, col in ((REF, 3), (PROBE, 4)):
                        wanted = np.frombuffer(part.column(col)[i].as_py() or b"", "<u8")
                        if len(wanted):
                            hit[kind][mine] = np.isin(code[mine], wanted)
                hit[REF] &= own
                text = np.repeat(np.arange(len(ids)), np.diff(starts))
                for kind in (REF, PROBE):
                    run = np.flatnonzero(_around(at[hit[kind]], starts, doc[hit[kind]], block, min_words, size))
                    yield from packed.pack_entries(
                        ((runs[0][run] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), kind, ids, keys, text[run],
                        runs[0][run].astype("<u8"), (runs[1][run] >> np.uint64(32)).astype("<u4"),
                        (run - starts[text[run]]).astype("<u4") if kind == PROBE else None)

        yield from packed.batches_of(entries())

    return rows.mapInArrow(emit, packed.SCHEMA)


def _confirm(extensions: DataFrame, parts: int) -> DataFrame:
    """Starts of the runs that an earlier document has too, packed by document."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[dict]:
            bucket, refs, table, out = None, [], None, packed.Outbox(parts)
            for row in packed.rows_of(batches):
                if row["bucket"] != bucket:
                    bucket, refs, table = row["bucket"], [], None
                ids, keys, doc = packed.ids_of(row)
                first, second = np.frombuffer(row["a"], "<u8"), np.frombuffer(row["b"], "<u4")
                if row["kind"] == REF:
                    refs.append((first, second, ids[doc]))
                    if len(refs) >= 64:
                        refs = [_smallest(refs)]
                    continue
                if not refs:
                    continue
                table = table or _smallest(refs)
                known, other, low = table
                place = np.searchsorted(known, first)
                repeated = np.zeros(len(first), bool)
                open_ = np.flatnonzero(place < len(known))
                while len(open_):  # entries that share the first hash lie next to each other
                    open_ = open_[known[place[open_]] == first[open_]]
                    same = other[place[open_]] == second[open_]
                    repeated[open_[same]] = low[place[open_[same]]] < ids[doc[open_[same]]]
                    open_ = open_[~same]
                    place[open_] += 1
                    open_ = open_[place[open_] < len(known)]
                yield from out.add(PROBE, ids[doc[repeated]], keys[doc[repeated]],
                                   np.frombuffer(row["c"], "<u4")[repeated].astype("<u8"))
            yield from out.flush()

        yield from packed.batches_of(entries())

    return _streamed(extensions, parts).mapInArrow(meet, packed.SCHEMA)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list:
    """id (null: largest) and key (hash of the text): together they name a document in the joins."""
    text = F.col(text_col).cast("string")
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text")]


@contextmanager
def _own_shuffles_only(spark) -> Iterator[None]:
    """Delete a written table's shuffle files as soon as it is written: else they lie on disk beside the next job's until the
    driver collects the finished plans."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def repeated_runs(docs: DataFrame, scope: Scope, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = 13) -> DataFrame:
    """id, key, k1 (64-bit starts of the repeated runs) of every document that has one."""
    spark = docs.sparkSession
    packed.limit_batches(spark)
    rows = docs.select(*_keyed(docs, id_col, text_col))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, block = packed.partitions(spark, size), (min_words + 1) // 2
    hits = scope.table(packed.regroup(_probe(_anchors(rows, block, min_words, 2 * parts), parts), (REF, PROBE), parts))
    with_hits = rows.join(hits, ["id", "key"]).select("id", "key", "text", "k0", "k1")
    return scope.table(packed.regroup(_confirm(_extensions(with_hits, block, min_words, 2 * parts), parts), (PROBE,), parts))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13,
                   out: str = "repeats") -> DataFrame:
    """All rows of ``docs`` with the repeats cut out of ``text_col`` (with the white space that follows them), and
    struct ``out``: n_words, n_removed, spans (array of start, end word of each maximal repeat)."""
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    names = docs.columns
    spark = docs.sparkSession
    fields = [T.StructField(f"c{i}", docs.schema[i].dataType) for i in range(len(names))]
    extra = "n_words long, n_removed long, spans array<struct<start: long, end: long>>, cut string"
    out_schema = T.StructType([*fields, *T._parse_datatype_string(extra).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _texts(batches):
            data, off = _flat(part.column(2))
            (_,), starts = word_hashes(part.column(2))
            text, n = part.column(2).to_pylist(), np.diff(starts)
            removed, spans = np.zeros(len(n), np.int64), [[] for _ in n]
            for i, raw in enumerate(part.column(3).to_pylist()):
                if not raw:
                    continue
                mark = np.zeros(int(n[i]) + 1, np.int64)
                run = np.frombuffer(raw, "<u8").astype(np.int64)
                np.add.at(mark, run, 1)
                np.add.at(mark, run + min_words, -1)
                gone = np.cumsum(mark)[:-1] > 0
                edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                spans[i] = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                removed[i] = int(gone.sum())
                mine = data[off[i]:off[i + 1]]
                word = ~_SPACE[mine]
                first = word.copy()
                first[1:] &= ~word[:-1]
                number = np.cumsum(first) - 1  # word of each byte; white space belongs to the word before it
                keep = (number < 0) | ~gone[np.maximum(number, 0)]
                text[i] = mine[keep].tobytes().decode()
            yield pa.RecordBatch.from_arrays(
                [*(part.column(4 + j) for j in range(len(names))), pa.array(n, pa.int64()), pa.array(removed),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(text, pa.string())],
                names=[f"c{j}" for j in range(len(names))] + ["n_words", "n_removed", "spans", "cut"])

    with _own_shuffles_only(spark), Scope(spark) as scope:
        runs = repeated_runs(docs, scope, id_col, text_col, min_words)
        carried = [F.col(f"`{c}`").alias(f"c{i}") if c != text_col else F.lit(None).cast(docs.schema[i].dataType).alias(f"c{i}")
                   for i, c in enumerate(names)]
        rows = docs.select(*_keyed(docs, id_col, text_col), *carried)
        joined = rows.join(runs, ["id", "key"], "left").select(
            "id", "key", "text", "k1", *[f"c{i}" for i in range(len(names))])
        done = cut_lineage(joined.mapInArrow(cut, out_schema))
    back = [F.col("cut").alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return done.select(*back, F.struct("n_words", "n_removed", "spans").alias(out))
