"""Fill-in-the-middle rearrangement over seekable compressed frames.

A text is stored as independent Zstandard frames of at most ``frame_bytes`` bytes, each with the number of units
(``[A-Za-z]+|[^A-Za-z]``) and code points that begin before it, and whether it begins inside a unit.  The two cuts of a
document are unit numbers, so the counts name the frame that holds each: only these cut frames are decompressed.  The output
is again an ordered list of frames: whole stored frames are taken over as they are, the parts of cut frames and the
markers are frames of their own.  Zstandard frames in a row are one valid stream, so the list joined up is the output's
compressed file.  Digests and restored texts stream the frames in order, one in memory at a time; a restored text is read
off the output alone, by searching it for the markers (they may lie across frames) and seeking to the ranges between them.

Scale: one pass over the texts, no shuffle, no model; a task holds an Arrow batch, the compressed frames of a row and
one or two open frames.

Defined cases: a null text is empty; an empty text, or one that holds a marker, stays plain, and so does the share of
documents that the hash leaves alone; a null id is hashed as an empty decimal; rows that repeat an id are cut by the
same hash; a unit longer than a frame crosses frames and still counts once; an empty table gives an empty result; other
columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.llm.packed import limit_batches
from storewatch.llm.words import _flat, row_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FRAME_BYTES = 1 << 16
SLICE = 4 << 20
STORE = ("doc_id long, n long, marked boolean, frames array<struct<units: long, chars: long, joined: boolean, data: binary>>")
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _heads(data: np.ndarray) -> np.ndarray:
    """Bytes that begin a code point."""
    return (data & 0xC0) != 0x80


def _unit_starts(data: np.ndarray, fresh: np.ndarray | int, joined: bool = False) -> np.ndarray:
    """Bytes that begin a unit; at the places ``fresh`` a text begins (a letter there continues nothing)."""
    letter = _LETTER[data]
    after = np.zeros(len(data), bool)
    after[1:] = letter[:-1]
    after[fresh] = joined
    return _heads(data) & ~(letter & after)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """doc_id, n (units), marked (a marker is in the text), frames (units and code points that begin before, whether the
    frame begins inside a unit, compressed bytes) of every row."""
    limit_batches(docs.sparkSession)
    fields = [("units", pa.int64()), ("chars", pa.int64()), ("joined", pa.bool_()), ("data", pa.binary())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for lo, hi in row_slices(batch.column(1), SLICE):
                data, off = _flat(batch.column(1).slice(lo, hi - lo))
                first = off[:-1][off[:-1] < off[1:]]
                starts = _unit_starts(data, first)
                units = np.concatenate([[0], np.cumsum(starts)])
                head = _heads(data)
                chars = np.concatenate([[0], np.cumsum(head)])
                count = -(-np.diff(off) // frame_bytes)
                row = np.repeat(np.arange(hi - lo), count)
                at = off[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * frame_bytes
                for _ in range(3):  # a code point has at most three more bytes
                    at = at - ~head[at]
                end = np.append(at[1:], len(data))
                raw = data.tobytes()
                marked = [any(m in raw[a:b] for m in (PREFIX, SUFFIX, MIDDLE)) for a, b in zip(off[:-1], off[1:], strict=True)]
                frames = pa.StructArray.from_arrays(
                    [pa.array(units[at] - units[off[row]]), pa.array(chars[at] - chars[off[row]]), pa.array(~starts[at]),
                     pa.array([pack(raw[a:b]) for a, b in zip(at, end, strict=True)], pa.binary())], fields=[pa.field(*f) for f in fields])
                ends = np.concatenate([[0], np.cumsum(count)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(units[off[1:]] - units[off[:-1]]), pa.array(marked, pa.bool_()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), frames)], names=["doc_id", "n", "marked", "frames"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, STORE)


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four 32-bit numbers of a document: the first 8-digit groups of the sha256 of ``seed:doc_id``."""
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(raw[i:i + 4], "big") for i in range(0, 16, 4))


class Frames:
    """Stored frames of one text: cuts by unit number, ranges between cuts as frames."""

    def __init__(self, frames: list[dict], n: int):
        self.frames, self.n, self.open = frames, n, {}
        self.units = [f["units"] for f in frames]

    def _bytes(self, i: int) -> bytes:
        if i not in self.open:
            self.open[i] = zstandard.ZstdDecompressor().decompress(self.frames[i]["data"])
        return self.open[i]

    def cut(self, unit: int) -> tuple[int, int, int]:
        """Frame, byte in it and code points before the unit with this number (``n``: the end)."""
        if unit == self.n:
            last = len(self.frames) - 1
            return last + 1, 0, self.frames[last]["chars"] + int(_heads(np.frombuffer(self._bytes(last), np.uint8)).sum())
        i = int(np.searchsorted(self.units, unit, side="right")) - 1
        data = np.frombuffer(self._bytes(i), np.uint8)
        byte = int(np.flatnonzero(_unit_starts(data, 0, self.frames[i]["joined"]))[unit - self.units[i]])
        return i, byte, self.frames[i]["chars"] + int(_heads(data[:byte]).sum())

    def between(self, a: tuple, b: tuple, pack) -> Iterator[bytes]:
        """Frames of the text from cut a to cut b: stored ones where they are whole."""
        for i in range(a[0], min(b[0] + 1, len(self.frames))):
            lo, hi = a[1] if i == a[0] else 0, b[1] if i == b[0] else None
            if lo == 0 and hi is None:
                yield self.frames[i]["data"]
            elif part := self._bytes(i)[lo:hi]:
                yield pack(part)


def rearrange(store: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and the output's frames."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("frames", pa.list_(pa.binary()))])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        p, s, m = pack(PREFIX), pack(SUFFIX), pack(MIDDLE)

        def one(row: dict) -> dict:
            h, n = draws(seed, row["doc_id"]), row["n"]
            out = {"doc_id": row["doc_id"], "n": n, "form": "plain", "prefix_chars": None, "middle_chars": None}
            if n == 0 or row["marked"] or h[2] % 100 >= percent:
                return out | {"frames": [f["data"] for f in row["frames"]]}
            text = Frames(row["frames"], n)
            begin, end = (0, 0, 0), (len(text.frames), 0, 0)
            a, b = (text.cut(u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
            prefix, middle, suffix = (list(text.between(*r, pack)) for r in ((begin, a), (a, b), (b, end)))
            out |= {"prefix_chars": a[2], "middle_chars": b[2] - a[2]}
            if h[3] % 100 < spm_percent:
                return out | {"form": "spm", "frames": [s, *suffix, p, *prefix, m, *middle]}
            return out | {"form": "psm", "frames": [p, *prefix, s, *suffix, m, *middle]}

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield pa.RecordBatch.from_pylist([one(r) for r in batch.slice(at, 1000).to_pylist()], schema=schema)

    return store.mapInArrow(turn, OUTPUT)


def output_chunks(frames: list[bytes]) -> Iterator[bytes]:
    """The output's bytes, frame by frame."""
    for frame in frames:
        yield zstandard.ZstdDecompressor().decompress(frame)


def _marker_places(frames: list[bytes], markers: tuple[bytes, ...]) -> tuple[list[int], list[int]]:
    """Byte places of the markers, which follow each other in the output, and where each frame begins (and the end)."""
    places, begins, tail, wanted = [], [0], b"", list(markers)
    for chunk in output_chunks(frames):
        base, seen = begins[-1] - len(tail), tail + chunk
        while wanted and (at := seen.find(wanted[0])) >= 0:
            places.append(base + at)
            base, seen = base + at + len(wanted[0]), seen[at + len(wanted[0]):]
            wanted.pop(0)
        begins.append(begins[-1] + len(chunk))
        tail = seen[-2:]
    if wanted or places[:1] != [0]:
        raise ValueError("the output does not hold its markers")
    return places, begins


def restored_chunks(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The text behind an output, in order, from the output and its form alone."""
    if form == "plain":
        yield from output_chunks(frames)
        return
    (x, y, z), begins = _marker_places(frames, (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE))
    first, second, middle = (x + 3, y), (y + 3, z), (z + 3, begins[-1])
    for lo, hi in (first, middle, second) if form == "psm" else (second, middle, first):
        for i in range(max(0, int(np.searchsorted(begins, lo, side="right")) - 1), len(frames)):
            if begins[i] >= hi:
                break
            (data,) = output_chunks(frames[i:i + 1])
            yield data[max(0, lo - begins[i]):hi - begins[i]]


def _per_row(outputs: DataFrame, make, drop: str, added: str) -> DataFrame:
    names = [c for c in outputs.columns if c != drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames, forms = batch.column("frames"), batch.column("form").to_pylist()
            made = [make(f.as_py(), form) for f, form in zip(frames, forms, strict=True)]
            new = {k: pa.array([m[k] for m in made], pa.string()) for k in added.split()}
            yield pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in names}, **new})

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in outputs.select(*names).schema.fields)
    return outputs.mapInArrow(run, f"{kept}, " + ", ".join(f"{k} string" for k in added.split()))


def digests(outputs: DataFrame) -> DataFrame:
    """Rows of :func:`rearrange` with output_sha256 and restored_sha256 (of the text rebuilt from the output) for frames."""
    def make(frames: list[bytes], form: str) -> dict:
        out = {}
        for name, chunks in (("output_sha256", output_chunks(frames)), ("restored_sha256", restored_chunks(frames, form))):
            digest = hashlib.sha256()
            for chunk in chunks:
                digest.update(chunk)
            out[name] = digest.hexdigest()
        return out

    return _per_row(outputs, make, "frames", "output_sha256 restored_sha256")


def texts(outputs: DataFrame) -> DataFrame:
    """Rows of :func:`rearrange` with the output and the restored text themselves for frames."""
    def make(frames: list[bytes], form: str) -> dict:
        return {"output": b"".join(output_chunks(frames)).decode(), "restored": b"".join(restored_chunks(frames, form)).decode()}

    return _per_row(outputs, make, "frames", "output restored")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, percent: int = 90,
                   spm_percent: int = 20, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Every text rearranged for fill-in-the-middle training (:func:`rearrange` of :func:`store_texts`)."""
    return rearrange(store_texts(docs, id_col, text_col, frame_bytes), seed, percent, spm_percent)
