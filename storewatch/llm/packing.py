"""Packing token sequences by patterns fitted with non-negative least squares.

The lengths' histogram (one count per length up to ``capacity``) is all that planning needs, whatever the
corpus size.  Lengths fall into classes; patterns are the multisets of up to ``most`` classes whose lengths
can fill a sequence exactly.  Non-negative least squares finds repeat counts whose class usage is closest
to the class histogram; they are rounded down and each pattern is filled with actual lengths whose sum is
the capacity.  What is left is packed best-fit, longest first, in bulk: equal lengths go into equal gaps
together, so planning costs depend on the number of distinct lengths and gaps only.

The plan says, for the r-th piece of each length, its sequence and offset.  Pieces get their rank without
ordering them: tasks number their own pieces per length and add the counts of the tasks before.

Scale: texts are tokenised once into a narrow piece table; the driver sees one row per distinct length;
the plan that is broadcast is bounded by the capacity (see ``plan``), not by the corpus.

Defined cases: a null text is an empty document, one end id; only documents longer than ``capacity`` are
cut, into whole pieces and a shorter last one; repeated rows and null ids are pieces of their own; an
empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storewatch.llm.packed import limit_batches
from storewatch.llm.tokens import token_ids, vocab_size
from storewatch.llm.words import row_slices
from storewatch.session import Scope, cut_lineage
from storewatch.sources.tables import small_side

CLASSES = 32
OFFSET_ROWS = 500_000  # (length, task) counts that are broadcast; beyond it the pieces are shuffled to them
Group = tuple[int, tuple[tuple[int, int], ...]]  # sequences, ((length, pieces of it in each), ...)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min ||a x - b|| over x >= 0 by the active set method."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[1]):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        free[best] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (z <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
        x = z
    return x


def class_patterns(capacity: int, classes: int, most: int) -> list[tuple[int, ...]]:
    """Multisets of up to ``most`` classes, largest first, whose lengths can sum to ``capacity``."""
    width = capacity // classes
    out = []
    for k in range(1, most + 1):
        for pick in itertools.combinations_with_replacement(range(classes - 1, -1, -1), k):
            if width * sum(pick) + k <= capacity <= width * (sum(pick) + k):
                out.append(pick)
    return out


def _fill(pattern: tuple[int, ...], times: int, left: np.ndarray, width: int, capacity: int) -> Iterator[Group]:
    """Up to ``times`` sequences of a class pattern that lengths still ``left`` fill exactly, equal ones together.

    All slots but the last two take the length nearest to what leaves the later slots their middle; the last
    two take the most frequent pair with the right sum.  Stops when no exact filling is found."""
    while times > 0:
        room, used = capacity, np.zeros(capacity + 1, np.int64)
        for i, c in enumerate(pattern[:-2]):
            later = sum(width * d + (width + 1) // 2 for d in pattern[i + 1:])
            have = np.flatnonzero((left - used)[width * c + 1:width * (c + 1) + 1] > 0) + width * c + 1
            if not len(have):
                return
            length = int(have[np.argmin(np.abs(have - (room - later)))])
            used[length] += 1
            room -= length
        free = left - used
        if len(pattern) == 1:
            pair = [capacity] if free[capacity] > 0 else []
        else:
            c, d = pattern[-2:]
            first = np.arange(max(width * c + 1, room - width * (d + 1)), min(width * (c + 1), room - width * d - 1) + 1)
            first = first[(first >= 1) & (first < room)]
            ways = np.where(first * 2 == room, free[first] // 2, np.minimum(free[first], free[room - first]))
            best = int(np.argmax(ways)) if len(ways) else 0
            pair = [int(first[best]), room - int(first[best])] if len(ways) and ways[best] > 0 else []
        if not pair:
            return
        for length in pair:
            used[length] += 1
        content = [(int(n), int(used[n])) for n in np.flatnonzero(used)[::-1]]
        n = min(times, *(int(left[length]) // k for length, k in content))
        left -= n * used
        times -= n
        yield n, tuple(content)


def _best_fit(left: np.ndarray, groups: list[Group], capacity: int) -> list[Group]:
    """Pack the lengths still ``left``, longest first, each into the fullest sequences that have room."""
    by_room: dict[int, list[Group]] = {}
    for n, content in groups:
        by_room.setdefault(capacity - sum(length * k for length, k in content), []).append((n, content))
    for length in range(capacity, 0, -1):
        pieces = int(left[length])
        while pieces:
            room = next((r for r in range(length, capacity) if by_room.get(r)), capacity)
            n, content = by_room[room].pop() if by_room.get(room) else (-(-pieces // (capacity // length)), ())
            each = room // length
            full = min(n, pieces // each)
            rest = 0 if full == n else pieces - full * each
            rest = min(rest, each)
            if full:
                by_room.setdefault(room - each * length, []).append((full, (*content, (length, each))))
            if rest:
                by_room.setdefault(room - rest * length, []).append((1, (*content, (length, rest))))
            spare = n - full - (1 if rest else 0)
            if spare and content:
                by_room.setdefault(room, []).append((spare, content))
            pieces -= full * each + rest
    return [g for gs in by_room.values() for g in gs]


def plan(histogram: np.ndarray, capacity: int, classes: int = CLASSES, most: int = 4,
         rounds: int = 1) -> list[Group]:
    """Groups of equal sequences that hold ``histogram[n]`` pieces of each length n.

    The number of groups is bounded by distinct lengths x patterns used (at most ``classes`` a round) plus a
    few per distinct length, so by the capacity."""
    left = histogram.astype(np.int64).copy()
    groups: list[Group] = []
    if capacity % classes == 0 and capacity >= classes:
        width = capacity // classes
        patterns = class_patterns(capacity, classes, most)
        usage = np.zeros((classes, len(patterns)))
        for j, pattern in enumerate(patterns):
            for c in pattern:
                usage[c, j] += 1
        for _ in range(rounds):  # what exact filling could not use is fitted again
            held = left[1:].reshape(classes, width).sum(axis=1)
            times = np.floor(nnls(usage, held.astype(float)) + 1e-9).astype(np.int64)
            made = [g for j in np.argsort([len(p) for p in patterns], kind="stable") if times[j]
                    for g in _fill(patterns[j], int(times[j]), left, width, capacity)]
            groups += made
            if not made:
                break
    return _best_fit(left, groups, capacity)


def id_type(tokenizer: str) -> str:
    """Numpy type of stored ids: 16 bits if they hold every id of the vocabulary, else 32."""
    return "<u2" if vocab_size(tokenizer) <= 1 << 16 else "<u4"


def unpack_ids(raw: bytes, length: int) -> np.ndarray:
    """The ids of a stored piece of ``length`` ids."""
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * length else "<u4")


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text",
           end_id: int = 0, with_ids: bool = False, slice_bytes: int = 2 << 20) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, ids (null unless ``with_ids``:
    little-endian unsigned numbers of :func:`id_type`), and part, nth: the task that made it and its number among that task's
    pieces of the length."""
    kind = id_type(tokenizer)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("nth", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what an earlier stage left with this worker
        part, made = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, hi in row_slices(batch.column(1), slice_bytes):
                ids, off = token_ids(batch.column(1).slice(lo, hi - lo), tokenizer, end_id)
                count = -(-np.diff(off) // capacity)
                row = np.repeat(np.arange(hi - lo), count)
                number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = number * capacity
                length = np.minimum(capacity, np.repeat(np.diff(off), count) - start)
                first = off[row] + start
                raw = ids.astype("<u4")
                parts = [raw[a:b] for a, b in zip(first, first + length, strict=True)]
                kept = pa.nulls(len(parts), pa.binary())
                if with_ids:  # pieces follow each other in ``ids`` without a gap
                    small = ids.astype(kind)
                    bounds = (np.append(first, len(ids)) * small.itemsize).astype(np.int32)
                    kept = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(bounds), pa.py_buffer(small)])
                order = np.argsort(length, kind="stable")
                run = np.concatenate([[True], np.diff(length[order]) != 0]) if len(order) else np.zeros(0, bool)
                at = np.arange(len(order))
                nth = np.empty(len(order), np.int64)
                nth[order] = made[length[order]] + at - np.maximum.accumulate(np.where(run, at, 0))
                made += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(lo, hi - lo).take(pa.array(row)), "piece": number.astype(np.int32),
                    "start": start, "length": length, "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts],
                    "ids": kept,
                    "part": np.full(len(row), part, np.int32), "nth": nth}, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, "
                                "part int, nth long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    ``with_ids`` keeps the token ids of each piece; :func:`sequences` joins them up."""
    spark = docs.sparkSession
    with Scope(spark) as scope:
        made = scope.table(pieces(docs, tokenizer, capacity, id_col, text_col, end_id, with_ids))
        counts = made.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
        histogram = np.zeros(capacity + 1, np.int64)
        for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
            histogram[r.length] = r.n
        slots, base, seen = [], 0, np.zeros(capacity + 1, np.int64)
        for n, content in plan(histogram, capacity):
            offset = 0
            for length, each in content:
                slots.append((length, int(seen[length]), int(seen[length]) + n * each, base, each, offset))
                seen[length] += n * each
                offset += length * each
            base += n
        table = spark.createDataFrame(slots, "length long, lo long, hi long, base long, each long, first long")
        before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        offsets = small_side(scope.table(offsets), OFFSET_ROWS)  # pieces stay where they are if the counts of all tasks are few
        ranked = made.join(offsets, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
        inside = (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
        at = F.col("rank") - F.col("lo")
        placed = ranked.join(F.broadcast(table), inside).select(
            "doc_id", "piece", "start", ranked["length"], "ids_crc32", "ids",
            (F.col("base") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("first") + at % F.col("each") * ranked["length"]).cast("long").alias("offset"))
        return cut_lineage(placed)


def digests(packed: DataFrame) -> DataFrame:
    """The rows of :func:`pack` (needs ``with_ids``) without ids; length and ids_crc32 are those of the packed ids."""
    limit_batches(packed.sparkSession)
    names = [c for c in packed.columns if c != "ids"]
    at = packed.columns.index("ids")

    length = packed.columns.index("length")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [unpack_ids(raw, n) for raw, n in zip(batch.column(at).to_pylist(), batch.column(length).to_pylist(), strict=True)]
            made = {"length": pa.array([len(i) for i in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(i.astype("<u4")) for i in ids], pa.int64())}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(batch.schema.get_field_index(n))) for n in names], names=names)

    return packed.mapInArrow(digest, packed.select(*names).schema)


def with_arrays(packed: DataFrame) -> DataFrame:
    """The rows of :func:`pack` (needs ``with_ids``) with ``ids`` as an array of numbers."""
    limit_batches(packed.sparkSession)
    at, length = packed.columns.index("ids"), packed.columns.index("length")
    ddl = ", ".join(f"{f.name} {'array<long>' if f.name == 'ids' else f.dataType.simpleString()}" for f in packed.schema.fields)

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [unpack_ids(raw, n).astype(np.int64) for raw, n in zip(batch.column(at).to_pylist(), batch.column(length).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64())) if i == at else c for i, c in enumerate(batch.columns)],
                                             names=batch.schema.names)

    return packed.mapInArrow(open_, ddl)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves (needs ``with_ids``); at most ``capacity`` ids a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return with_arrays(packed).groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
