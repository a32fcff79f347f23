"""Training rows as numpy blocks: what the tree and network learners pass over again and again.

A block is one row of binary columns that holds up to about ``BLOCK_ROWS`` training rows; rows are dealt to blocks by a hash of
their key and sorted by it, so the same table always gives the same blocks.  Features lie by column, each in its shortest lossless form
(``pack``): one-hot slots as bits, repeating numbers as codes.  A learner's step is a function of one block; the sum
of its results over all blocks is what the step needs (``kept_sum``: summed per task, then over the tasks).  A learner of many steps
keeps what it needs of the blocks with the executors (``keep``), so a step is one short job that neither reads nor shuffles the
table.  A table of one block takes the same steps inside one task (``fit_in_task``): no job per step, same numbers.
"""
from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16
PIECE = 1 << 14
TASKS_SUMMED_AT_ONCE = 16
BLOCKS = "bucket int, n int, h binary, x binary, y binary, state binary"


@dataclass
class Block:
    """Rows of one block: key hashes (uint64), features (rows x width), labels, and what a learner keeps per row."""
    bucket: int
    h: np.ndarray
    x: np.ndarray
    y: np.ndarray
    state: np.ndarray | None

    @staticmethod
    def of(row: dict) -> Block:
        h = np.frombuffer(row["h"], "<u8")
        state = None if row["state"] is None else np.frombuffer(row["state"], "<f8")
        return Block(row["bucket"], h, unpack(row["x"], len(h)), np.frombuffer(row["y"], "<f8"), state)


_BITS, _CODES8, _CODES16, _VALUES = range(4)


def _pack_column(v: np.ndarray) -> bytes:
    if ((v == 0) | (v == 1)).all():
        return bytes([_BITS]) + np.packbits(v > 0).tobytes()
    values, codes = np.unique(v, return_inverse=True)
    kind, small = (_CODES8, np.uint8) if len(values) <= 256 else (_CODES16, np.dtype("<u2"))
    if len(values) > 65_536 or 8 * len(values) + np.dtype(small).itemsize * len(v) >= 8 * len(v):
        return bytes([_VALUES]) + v.astype("<f8").tobytes()
    return bytes([kind]) + len(values).to_bytes(4, "little") + values.astype("<f8").tobytes() + codes.astype(small).tobytes()


def pack(x: np.ndarray) -> bytes:
    """Rows by columns, every column in its shortest lossless form: bits, codes of its distinct values, or the values."""
    columns = [_pack_column(np.ascontiguousarray(c, float)) for c in x.T]
    return np.array([len(columns), *map(len, columns)], "<i4").tobytes() + b"".join(columns)


def packed_columns(data: bytes) -> list[bytes]:
    """The columns of :func:`pack`, still packed."""
    width = int(np.frombuffer(data, "<i4", 1)[0])
    ends = 4 * (width + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<i4", width, 4))])
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def is_bits(column: bytes) -> bool:
    return column[0] == _BITS


def distinct(column: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a packed column of ``n`` rows in ascending order, and each row's place among them (a column kept as values is sorted here)."""
    kind = column[0]
    if kind == _BITS:
        return np.array([0.0, 1.0]), np.unpackbits(np.frombuffer(column, np.uint8, offset=1), count=n)
    if kind == _VALUES:
        return np.unique(np.frombuffer(column, "<f8", offset=1), return_inverse=True)
    size = int.from_bytes(column[1:5], "little")
    values = np.frombuffer(column, "<f8", size, 5)
    return values, np.frombuffer(column, np.uint8 if kind == _CODES8 else "<u2", offset=5 + 8 * size)


def unpack(data: bytes, n: int) -> np.ndarray:
    """Rows by columns again."""
    columns = packed_columns(data)
    out = np.empty((n, len(columns)))
    for j, c in enumerate(columns):
        if c[0] == _VALUES:
            out[:, j] = np.frombuffer(c, "<f8", offset=1)
        else:
            values, codes = distinct(c, n)
            out[:, j] = values[codes]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def uniform(h: np.ndarray, *seed: int) -> np.ndarray:
    """A number in [0, 1) for each hash and seed, the same wherever the row lies."""
    for s in seed:
        h = mix(h + np.uint64((s * 0x9E3779B97F4A7C15 + 1) % 2**64))
    return (h >> np.uint64(11)) / float(1 << 53)


def to_blocks(rows: DataFrame, keys: list, x: str = "x", y: str = "y", block_rows: int = BLOCK_ROWS, texts: bool = False) -> DataFrame:
    """``rows`` (keys, an array of doubles and a label; none of them null) as blocks; ``texts``: with the keys as JSON (:func:`key_texts`)."""
    limit_batches(rows.sparkSession)
    count = max(1, -(-rows.count() // block_rows))
    h = F.xxhash64(*[F.col(k).cast("string") for k in keys])
    dealt = rows.select(F.pmod(h, F.lit(count)).cast("int").alias("bucket"), h.alias("h"), F.col(y).cast("double").alias("y"), F.col(x).alias("x"),
                        F.to_json(F.struct(*keys)).alias("k"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                xs = t.column("x").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
                made = {
                    "bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()), "n": pa.array([t.num_rows], pa.int32()),
                    "h": [t.column("h").to_numpy().astype("<i8").tobytes()], "x": [pack(xs)],
                    "y": [t.column("y").to_numpy().astype("<f8").tobytes()], "state": pa.array([None], pa.binary())}
                if texts:
                    made["texts"] = [zlib.compress("\n".join(t.column("k").to_pylist()).encode(), 1)]
                yield pa.RecordBatch.from_pydict(made)

        for batch in batches:
            bucket = np.asarray(batch.column("bucket"))
            edges = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip(np.append(0, edges), np.append(edges, len(bucket)), strict=True):
                if hi > lo:
                    if held and held[0].column("bucket")[0].as_py() != bucket[lo]:
                        yield from flush()
                    held.append(batch.slice(lo, hi - lo))
        yield from flush()

    tasks = min(count, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "h", "k").mapInArrow(make, BLOCKS + (", texts binary" if texts else ""))


def key_texts(data: bytes) -> list[str]:
    """The keys of a block's rows (``texts``) as JSON, one line each: JSON escapes line ends within a key."""
    return zlib.decompress(data).decode().split("\n")


def limit_batches(spark: SparkSession, limit: str = "4m") -> None:
    """Bound the bytes of an Arrow batch unless the session already does: rows here are as large as blocks."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "-1", str(2**31 - 1), str(2**63 - 1)):
        spark.conf.set(name, limit)


def block_sum(blocks: DataFrame, step: Callable[[Block], np.ndarray], size: int) -> np.ndarray:
    """Sum over all blocks of the vector that ``step`` makes of each: one aggregate of the table."""
    rows = -(-size // PIECE)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rows * PIECE)
        for batch in batches:
            for row in batch.to_pylist():
                total[:size] += step(Block.of(row)).reshape(-1)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(range(rows), pa.int32()),
                                          "data": [p.astype("<f8").tobytes() for p in total.reshape(rows, PIECE)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                total[row["piece"]] = total.get(row["piece"], 0.0) + np.frombuffer(row["data"], "<f8")
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(total), pa.int32()), "data": [v.tobytes() for v in total.values()]})

    parts = blocks.mapInArrow(each, "piece int, data binary")
    out = np.zeros(rows * PIECE)
    for r in parts.repartition(min(rows, 64), "piece").mapInArrow(add, "piece int, data binary").collect():  # one vector
        out[r.piece * PIECE:(r.piece + 1) * PIECE] = np.frombuffer(r.data, "<f8")
    return out[:size]


def keep(blocks: DataFrame, each: Callable[[Block], object]) -> RDD:
    """What ``each`` makes of every block, held by the executors (memory, else disk), blocks dealt evenly; ``unpersist`` when done."""
    sc = blocks.sparkSession.sparkContext
    dealt = blocks.rdd.map(lambda r: (r["bucket"], r.asDict()))
    count = blocks.count()
    dealt = dealt.partitionBy(max(1, min(count, sc.defaultParallelism)), lambda bucket: bucket)

    def ordered(rows: Iterator) -> Iterator:
        for _, row in sorted(((b, {k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.items()}) for b, r in rows), key=lambda r: r[0]):
            yield each(Block.of(row))

    return dealt.mapPartitions(ordered).persist(StorageLevel.MEMORY_AND_DISK)


def kept_sum(kept: RDD, step: Callable[[object], np.ndarray], size: int) -> np.ndarray:
    """Sum over all kept blocks of the vector that ``step`` makes of each: one job of one stage, or a tree of sums when there are
    many tasks."""
    def each(rows: Iterator) -> Iterator[np.ndarray]:
        total = np.zeros(size)
        for row in rows:
            total += step(row).reshape(-1)
        yield total

    parts = kept.mapPartitions(each)
    if kept.getNumPartitions() > TASKS_SUMMED_AT_ONCE:
        return parts.treeReduce(np.add)
    return sum(parts.collect(), np.zeros(size))  # a vector a task, in the tasks' order


def map_state(blocks: DataFrame, update: Callable[[Block], np.ndarray]) -> DataFrame:
    """Blocks with a new per-row state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = [np.asarray(update(Block.of(r)), "<f8").tobytes() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(state, pa.binary())], names=batch.schema.names)

    return blocks.mapInArrow(run, BLOCKS)


def fit_in_task(block: DataFrame, fits: dict[str, Callable[[Block], object]], whole: bool = False) -> dict[str, object]:
    """Models that each function fits to the one block of a table, every function in a task of its own; ``whole``: to the rows of all blocks
    of a table that a task can hold (packed, in the blocks' order)."""
    names = list(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["fit"], []).append(row)
        for fit in sorted(held):
            rows = sorted(held.pop(fit), key=lambda r: r["bucket"])
            for given in ([rows] if whole else map(Block.of, rows)):
                model = pickle.dumps(fits[names[fit]](given))
                yield pa.RecordBatch.from_pydict({"fit": pa.array([fit], pa.int32()), "model": pa.array([model], pa.binary())})

    each = block.withColumn("fit", F.explode(F.array(*[F.lit(i) for i in range(len(names))])))
    made = each.repartitionByRange(len(names), "fit").mapInArrow(run, "fit int, model binary")
    return {names[r.fit]: pickle.loads(r.model) for r in made.collect()}  # noqa: S301 - written by this job
