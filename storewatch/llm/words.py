"""Word splitting and rolling n-gram hashes over Arrow text columns (numpy inside Spark tasks).

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``.  Every function works on whole
texts; long inputs are cut between rows, never inside one.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Two odd multipliers of the rolling hashes (64-bit arithmetic wraps).
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@dataclass
class Words:
    """Words of some texts: ``codes`` index ``vocab`` (bytes); text i owns words ``starts[i]:starts[i+1]``."""
    codes: np.ndarray
    vocab: pa.Array
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and their n+1 offsets; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words without the white space, word offsets into them, word offsets of the texts."""
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = off[(off > 0) & (off < len(data))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    spans = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=spans[1:])
    return data[word], spans, np.searchsorted(begin, off)


def _lower(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)


def split_words(col: pa.Array, lower: bool = False) -> Words:
    """Words of every row of a string column (``lower``: A-Z lower-cased first)."""
    data, off = _flat(col)
    packed, spans, starts = _spans(_lower(data) if lower else data, off)
    words = pa.Array.from_buffers(pa.large_binary(), len(spans) - 1, [None, pa.py_buffer(spans), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    return Words(np.asarray(coded.indices, dtype=np.int32), coded.dictionary, starts)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(lane: int, size: int, inverse: bool) -> np.ndarray:
    base = pow(_BASE[lane], -1, 1 << 64) if inverse else _BASE[lane]
    steps = np.full(size, np.uint64(base))
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _run_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
    """Sum of value * base^position over each run, shifted to position 0: one prefix sum for all runs."""
    size = 1 << max(10, int(len(values)).bit_length())  # powers of two: few tables to keep
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(lane, size, False)[:len(values)], out=total[1:])
    return (total[end] - total[begin]) * _powers(lane, size, True)[begin]


def _word_blocks(spans: np.ndarray, max_bytes: int = 1 << 17) -> Iterator[slice]:
    """Words of about ``max_bytes`` together: their bytes are spread to 64-bit numbers, several at a time, so a slice of text is not hashed at once."""
    lo = 0
    while lo < len(spans) - 1:
        hi = max(lo + 1, int(np.searchsorted(spans, spans[lo] + max_bytes, side="right")) - 1)
        yield slice(lo, hi)
        lo = hi


def word_hashes(col: pa.Array, lanes: int = 1, lower: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """One 64-bit hash per word and lane, and the texts' word offsets.  Lanes are independent."""
    data, off = _flat(col)
    packed, spans, starts = _spans(_lower(data) if lower else data, off)
    size = np.diff(spans)
    out = [np.empty(len(size), np.uint64) for _ in range(lanes)]
    for part in _word_blocks(spans):
        edge = spans[part.start:part.stop + 1]
        values = packed[edge[0]:edge[-1]].astype(np.uint64) + np.uint64(1)
        for lane in range(lanes):
            out[lane][part] = mix(_run_hash(values, edge[:-1] - edge[0], edge[1:] - edge[0], lane) ^ size[part].astype(np.uint64))
    for i in np.flatnonzero(size > 256):  # a polynomial is weak on long crafted words
        raw = packed[spans[i]:spans[i + 1]].tobytes()
        for lane in range(lanes):
            out[lane][i] = xxhash.xxh3_64_intdigest(raw, seed=lane)
    return out, starts


def ngram_hash(word_hash: np.ndarray, n: int, lane: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (also across texts: mask with :func:`inside`)."""
    if len(word_hash) < n:
        return np.zeros(0, np.uint64)
    begin = np.arange(len(word_hash) - n + 1)
    return mix(_run_hash(word_hash, begin, begin + n, lane))


def inside(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the flat word array) where a run of ``n`` words fits into its text, and their text index."""
    room = np.maximum(np.diff(starts) - n + 1, 0)
    text = np.repeat(np.arange(len(room)), room)
    first = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room)
    return np.arange(len(text)) + first, text


def row_slices(col: pa.Array, max_bytes: int, max_rows: int = 65_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text; one row is never cut."""
    _, off = _flat(col) if len(col) else (None, np.zeros(1, np.int64))
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + max_rows, len(col))
        yield lo, hi
        lo = hi
