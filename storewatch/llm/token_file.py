"""Token id files with fixed-width bit packing, random access by block, and the corpus writer and reader.

An id takes ``bits`` = the least number that holds every id of the vocabulary.  Ids are packed in blocks;
64 ids fill ``bits`` 64-bit words, so packing and unpacking are 64 vector operations per call whatever the
number of ids.  File: magic; blocks; footer with document ids (and a null flag each), each document's first
id, each block's byte offset; trailer with the sizes, the footer's place and the magic again.  A range of
ids is read by fetching just the blocks that cover it.

Scale: documents are range-partitioned and sorted by id, and every task writes files of its own partition
in a stream (memory: one batch and one block).  Files roll over at ``file_ids``; their manifest, one row per
file, is ordered to give each file its first position.  Lost executors: see ``files.py``.

Defined cases: a null text is empty and still has its end id; null ids come first; rows that repeat an id
are ordered by their text; an empty table writes no file and reads back empty; other columns are not read.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storewatch.llm.files import one_task_each, open_input, open_output
from storewatch.llm.tokens import token_ids, vocab_size
from storewatch.llm.words import row_slices

MAGIC = b"TOKBITS1"
TRAILER = struct.Struct("<IIQQQQ8s")  # bits, ids in a block, documents, ids, blocks, footer offset, magic
BLOCK_IDS = 4096
MANIFEST = "part int, seq int, path string, docs long, ids long"


def bits_for(vocab: int) -> int:
    """Bits that hold every id below ``vocab``."""
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, padded with zeros to a multiple of 64 ids."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.reshape(-1)[:len(ids)] = ids
    out = np.zeros((len(rows), bits), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= rows[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, k] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    words = np.frombuffer(raw, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = value & mask
    return out.reshape(-1)[:n].astype(np.uint32)


class TokenWriter:
    """Streams documents into one file."""

    def __init__(self, folder: str, bits: int):
        self.uri, self.out = open_output(folder, ".tok")
        self.bits, self.rest, self.ids, self.at = bits, np.zeros(0, np.uint32), 0, len(MAGIC)
        self.doc_ids, self.starts, self.blocks = [], [], []
        self.out.write(MAGIC)

    def _flush(self, ids: np.ndarray) -> None:
        for lo in range(0, len(ids), BLOCK_IDS):
            raw = pack(ids[lo:lo + BLOCK_IDS], self.bits)
            self.blocks.append(self.at)
            self.out.write(raw)
            self.at += len(raw)

    def add(self, doc_ids: list, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.starts.append(self.ids + offsets[:-1])
        self.ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK_IDS * BLOCK_IDS
        self._flush(ids[:whole])
        self.rest = ids[whole:]

    def close(self) -> tuple[str, int, int]:
        self._flush(self.rest)
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        names = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        starts = np.concatenate([*self.starts, [self.ids]]).astype("<i8")
        self.out.write(known.tobytes() + names.tobytes() + starts.tobytes() + np.array([*self.blocks, self.at], "<u8").tobytes())
        self.out.write(TRAILER.pack(self.bits, BLOCK_IDS, len(names), self.ids, len(self.blocks), self.at, MAGIC))
        self.out.close()
        return self.uri, len(names), self.ids


class TokenFile:
    """Random access to a file: documents in order, ids by range."""

    def __init__(self, stream):
        self.stream, size = stream, stream.size()
        if size < len(MAGIC) + TRAILER.size:
            raise ValueError("not a token file")
        bits, block, docs, ids, blocks, footer, magic = TRAILER.unpack(self._at(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC or self._at(0, len(MAGIC)) != MAGIC or footer + 17 * docs + 8 + 8 * (blocks + 1) + TRAILER.size != size:
            raise ValueError("not a token file, or cut short")
        self.bits, self.block_ids, self.n_ids = bits, block, ids
        raw = self._at(footer, size - TRAILER.size - footer)
        known, names = np.frombuffer(raw, np.uint8, docs), np.frombuffer(raw, "<i8", docs, docs)
        self.doc_ids = [int(d) if k else None for k, d in zip(known, names, strict=True)]
        self.starts = np.frombuffer(raw, "<i8", docs + 1, 9 * docs)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, 17 * docs + 8)

    def _at(self, place: int, n: int) -> bytes:
        self.stream.seek(place)
        return self.stream.read(n)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi-1 of the file; reads the blocks that hold them."""
        if not 0 <= lo <= hi <= self.n_ids:
            raise IndexError(f"ids {lo}:{hi} of {self.n_ids}")
        if lo == hi:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block_ids, (hi - 1) // self.block_ids
        raw = self._at(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        base = first * self.block_ids
        return unpack(raw, self.bits, hi - base)[lo - base:]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 0, file_ids: int = 1 << 27, slice_bytes: int = 8 << 20) -> DataFrame:
    """Tokenise whole texts in ascending id order into files below ``folder``; returns the manifest (lazy).

    ``tokenizer``: path of a public tokenizer file that every executor can read."""
    bits = bits_for(vocab_size(tokenizer))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out = TaskContext.get().partitionId(), 0, None

        def row(values: tuple[str, int, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [values[0]],
                 "docs": pa.array([values[1]], pa.int64()), "ids": pa.array([values[2]], pa.int64())})

        for batch in batches:
            for lo, hi in row_slices(batch.column(1), slice_bytes):
                out = out or TokenWriter(folder, bits)
                ids, offsets = token_ids(batch.column(1).slice(lo, hi - lo), tokenizer, end_id)
                out.add(batch.column(0).slice(lo, hi - lo).to_pylist(), ids, offsets)
                if out.ids >= file_ids:
                    yield row(out.close())
                    seq, out = seq + 1, None
        if out is not None:
            yield row(out.close())

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(write, MANIFEST)


def read_tokens(manifest: DataFrame, digest_only: bool = False, batch_ids: int = 1 << 20) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (null with ``digest_only``)."""
    before = Window.partitionBy().orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                with open_input(entry["path"]) as stream:
                    file = TokenFile(stream)
                    if file.n_ids != entry["ids"] or len(file.doc_ids) != entry["docs"]:
                        raise ValueError(f"{entry['path']} does not hold what its manifest says")
                    lo = 0
                    while lo < len(file.doc_ids):
                        hi = int(np.searchsorted(file.starts, file.starts[lo] + batch_ids, side="right")) - 1
                        hi = max(hi, lo + 1)
                        flat = file.ids(int(file.starts[lo]), int(file.starts[hi])).astype("<u4")
                        off = file.starts[lo:hi + 1] - file.starts[lo]
                        parts = [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": file.doc_ids[lo:hi], "start": file.starts[lo:hi] + entry["base"],
                            "n_tokens": np.diff(off), "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts],
                            "ids": [None] * len(parts) if digest_only else parts}, schema=schema)
                        lo = hi

    return one_task_each(files.select("path", "docs", "ids", "base")).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")
