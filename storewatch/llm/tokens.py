"""Token ids of whole texts with a public tokenizer file, by encoding each distinct chunk of a batch once.

Both supported tokenizer kinds split a text into pieces before any merge, and a piece never continues from
a non-space character into white space.  A text may therefore be cut in front of every run of white space
and the chunks encoded apart; concatenated, their ids are the text's ids.  Chunks repeat a lot, so only
the distinct ones go through the tokenizer, and a worker remembers the ids of those it met first, in arrays of
some 40 bytes a chunk.  A cut is also made between an ASCII letter and ASCII punctuation (not the apostrophe, which begins
contractions): pieces end there in both kinds.  Where a tokenizer lower-cases and drops white space, chunks are folded
before they are looked up.  Cuts at white space are made at ASCII white space; a text that also holds other white space (or the
separators 0x1C-0x1F), or the string of one of the tokenizer's special tokens, is encoded whole, since there a
piece could cross a cut.
"""
from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from storewatch.llm.words import _SPACE, _flat

_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[33:127] = True
_PUNCTUATION[48:58] = _PUNCTUATION[ord("'")] = False
_PUNCTUATION &= ~_LETTER
_MEMO_CHUNKS = 1_000_000  # the first ones met stay, which are the frequent ones
_AT_ONCE = 8192           # chunks that the tokenizer gets in one call: its results are large


class Memo:
    """Ids of chunks by a 128-bit hash: hashes in order of the first half, places in one flat array of ids."""

    def __init__(self, limit: int):
        self.limit, self.flat = limit, np.zeros(0, np.uint32)
        self.name, self.place, self.size = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, name: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where it is not known."""
        if not len(self.name):
            return np.full(len(name), -1)
        at = np.minimum(np.searchsorted(self.name[:, 0], name[:, 0]), len(self.name) - 1)
        return np.where((self.name[at] == name).all(axis=1), at, -1)

    def add(self, name: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        if len(self.name) >= self.limit or not len(name):
            return
        place = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, ids])
        name, place, size = (np.concatenate(x) for x in ((self.name, name), (self.place, place), (self.size, size)))
        order = np.argsort(name[:, 0], kind="stable")
        self.name, self.place, self.size = name[order], place[order], size[order]


@lru_cache(maxsize=4)
def _load(path: str, literal: bool = False):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = literal
    special = [] if literal else [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, Memo(_MEMO_CHUNKS), special, _folds(json.loads(tokenizer.to_str()))


def _folds(config: dict) -> bool:
    """Whether case and white space of ASCII never reach the ids: the text is lower-cased, and its words are cut out by a pattern
    whose parts exclude white space."""
    steps = (config.get("normalizer") or {}).get("normalizers", [])
    cutters = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (any(n["type"] == "Lowercase" for n in steps) and all(n["type"] in ("NFC", "Replace", "Lowercase") for n in steps) and bool(cutters)
            and cutters[0]["type"] == "Split" and cutters[0]["behavior"] == "Removed" and cutters[0]["invert"]
            and cutters[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"))


def vocab_size(path: str) -> int:
    return _load(path)[0].get_vocab_size(with_added_tokens=True)


def _encode(tokenizer, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat unsigned 32-bit ids of the chunks (bytes) and how many each has."""
    ids, sizes = array("I"), []
    for lo in range(0, len(chunks), _AT_ONCE):
        for e in tokenizer.encode_batch_fast([c.decode() for c in chunks[lo:lo + _AT_ONCE]], add_special_tokens=False):
            found = e.ids
            ids.extend(found)
            sizes.append(len(found))
    return np.frombuffer(ids, np.uint32) if ids else np.zeros(0, np.uint32), np.array(sizes, np.int64)


def _whole(col: pa.Array, data: np.ndarray, special: list) -> np.ndarray:
    """Rows that must not be cut."""
    odd = np.zeros(len(col), bool)
    if len(data) and (data >= 0x1C).any() and ((data > 0x7F).any() or ((data >= 0x1C) & (data <= 0x1F)).any()):
        odd = np.fromiter((t is not None and _ODD_SPACE.search(t) is not None for t in col.to_pylist()), bool, len(col))
    for content in special:
        odd |= np.asarray(pc.match_substring(col, content, ignore_case=True).fill_null(False))
    return odd


def token_ids(col: pa.Array, path: str, end_id: int | None = None, literal: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Flat unsigned 32-bit ids of all rows and their n+1 offsets; null is an empty text; ``end_id`` closes each row.

    ``literal``: strings of special tokens in a text are ordinary text, else they become the special tokens' ids."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    tokenizer, memo, special, folds = _load(path, literal)
    data, off = _flat(col)
    space = _SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[1:] |= _PUNCTUATION[data[1:]] & _LETTER[data[:-1]]
    cut[off[:-1][off[:-1] < len(data)]] = True
    whole = _whole(col, data, special)
    for i in np.flatnonzero(whole):
        cut[off[i]:off[i + 1]] = False
        if off[i] < off[i + 1]:
            cut[off[i]] = True
    begin = np.flatnonzero(cut)
    bounds = np.concatenate([begin, [len(data)]]).astype(np.int64)
    if folds:
        free = np.repeat(~whole, np.diff(off))
        data = data + ((data >= 65) & (data <= 90) & free).view(np.uint8) * np.uint8(32)
        kept = ~(space & free)
        bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
        data = data[kept]
    chunks = pa.Array.from_buffers(pa.large_binary(), len(begin),
                                   [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    distinct = chunks.dictionary.to_numpy(zero_copy_only=False)
    name = np.frombuffer(b"".join([xxhash.xxh3_128_digest(c) for c in distinct]), ">u8").reshape(-1, 2).astype(np.uint64)
    known = memo.find(name)
    new = np.flatnonzero(known < 0)
    fresh, sizes = _encode(tokenizer, distinct[new])
    size, place = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
    old = known >= 0
    size[old], place[old] = memo.size[known[old]], memo.place[known[old]]
    size[new], place[new] = sizes, len(memo.flat) + np.cumsum(sizes) - sizes
    flat = np.concatenate([memo.flat, fresh, [end_id or 0]]).astype(np.uint32)
    memo.add(name[new], sizes, fresh)
    codes = np.asarray(chunks.indices, dtype=np.int64)
    lens, from_ = size[codes], place[codes]
    in_row = np.bincount(np.searchsorted(off[1:], begin, side="right"), minlength=len(col))
    if end_id is not None:  # one more entry after the last chunk of each row
        rows = np.cumsum(in_row)
        from_, lens, in_row = np.insert(from_, rows, len(flat) - 1), np.insert(lens, rows, 1), in_row + 1
    ends = np.concatenate([[0], np.cumsum(lens)])
    take = np.repeat(from_ - ends[:-1], lens) + np.arange(ends[-1])
    return flat[take], np.concatenate([[0], ends[np.cumsum(in_row)]])
