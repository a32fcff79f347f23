"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is good or bad.  A line's evidence are features of the line itself and of the lines
before and after it; neighbouring labels are tied by a transition matrix.  Training maximises the
conditional likelihood of the line labels (a line takes its document's label) by its exact gradient from
forward-backward sums; scoring runs forward-backward over each document and averages the lines' marginals
of "good", weighted by line length.

Training reads at most ``max_train`` labelled rows (the first in hash order, none of the held-out rows, whole
texts, documents over ``max_train_chars`` skipped in training only) and is the only step on the driver:
its memory is bounded by these two parameters.  Scoring covers every document, is one pass without a
shuffle, and uses nothing but the text.

Defined cases: a null or empty text is one empty line and is scored like any; very long texts are scored
whole; labels other than 0 and 1, null ids and labels without a document are not learned from; of repeated
labels each counts; without labelled rows of both classes every score is the share of label 1 (0.5 without
any); repeated rows score alike; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storewatch.llm import packed
from storewatch.llm.words import _flat, _run_hash, _spans, mix, row_slices

SLICE = 2 << 20
TRAIN_SLICE = 1 << 18   # on the driver, beside the features
_CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "stop": b".,;:'\"()-?", "symbol": b"$#%&*@^~<>{}[]|\\/_=+`", "shout": b"!"}
_CLASS = {}
for _name, _bytes in _CLASSES.items():
    _CLASS[_name] = np.zeros(256, np.int64)
    _CLASS[_name][list(_bytes)] = 1
OWN = ["length", "upper", "digit", "stop", "symbol", "shout", "word", "short", "again", "distinct", "capital",
       "seen", "same_before", "same_after", "first", "last"]
NAMES = ["bias", *OWN, *[f"{n}_before" for n in OWN[:12]], *[f"{n}_after" for n in OWN[:12]]]


def line_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature matrix and byte length of all lines, and the rows' line offsets; a row has at least one line."""
    data, off = _flat(col)
    breaks = np.flatnonzero(data == 10)
    rows = len(off) - 1
    row_of = np.searchsorted(off, breaks, side="right") - 1
    lines = np.bincount(row_of, minlength=rows) + 1
    starts = np.concatenate([[0], np.cumsum(lines)])
    first = np.zeros(starts[-1], bool)
    first[starts[:-1]] = True
    last = np.zeros(starts[-1], bool)
    last[starts[1:] - 1] = True
    begin, end = np.empty(starts[-1], np.int64), np.empty(starts[-1], np.int64)
    begin[first], begin[~first] = off[:-1], breaks + 1
    end[last], end[~last] = off[1:], breaks
    size = end - begin
    share = np.maximum(size, 1).astype(float)

    def total(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(values)])
        return (run[hi] - run[lo]).astype(float)

    out = {name: total(table[data], begin, end) / share for name, table in _CLASS.items()}
    packed_bytes, spans, word_starts = _spans(data, off)
    word_size = np.diff(spans)
    values = packed_bytes.astype(np.uint64) + np.uint64(1)
    words = mix(_run_hash(values, spans[:-1], spans[1:], 0) ^ word_size.astype(np.uint64))
    # words before each line: the words of a line start inside it
    space = np.concatenate([[True], (data[:-1] == 32) | ((data[:-1] >= 9) & (data[:-1] <= 13))]) if len(data) else np.zeros(0, bool)
    head = np.zeros(len(data), bool)
    if len(data):
        head = space & ~((data == 32) | ((data >= 9) & (data <= 13)))
        at_row = off[:-1][off[:-1] < len(data)]
        head[at_row] = ~((data[at_row] == 32) | ((data[at_row] >= 9) & (data[at_row] <= 13)))
    count = np.concatenate([[0], np.cumsum(head)])
    lo, hi = count[begin], count[end]
    n = np.maximum(hi - lo, 1).astype(float)
    line_of = np.repeat(np.arange(len(begin)), hi - lo)
    again = np.zeros(len(words), np.int64)
    again[1:] = (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])
    order = np.lexsort((words, line_of))
    new = np.zeros(len(words), np.int64)
    new[order] = np.concatenate([[1], ((np.diff(line_of[order]) != 0) | (words[order][1:] != words[order][:-1])).astype(np.int64)])[:len(words)]
    lead = packed_bytes[spans[:-1]] if len(words) else np.zeros(0, np.uint8)
    out |= {"length": np.log1p(size), "word": size / n / 8, "short": total(word_size <= 3, lo, hi) / n,
            "again": total(again, lo, hi) / n, "distinct": total(new, lo, hi) / n,
            "capital": total((lead >= 65) & (lead <= 90), lo, hi) / n}
    text = mix(_run_hash(words, lo, hi, 0) ^ (hi - lo).astype(np.uint64))
    row = np.repeat(np.arange(rows), lines)
    order = np.lexsort((text, row))
    seen = np.zeros(len(row))
    seen[order[1:]] = (row[order][1:] == row[order][:-1]) & (text[order][1:] == text[order][:-1])
    before, after = np.zeros(len(row)), np.zeros(len(row))
    before[1:] = (text[1:] == text[:-1]) & ~first[1:]
    after[:-1] = before[1:]
    out |= {"seen": seen, "same_before": before, "same_after": after, "first": first.astype(float), "last": last.astype(float)}
    own = np.stack([out[name] for name in OWN], axis=1)
    near = own[:, :12]
    prior, later = np.zeros_like(near), np.zeros_like(near)
    prior[1:] = near[:-1] * ~first[1:, None]
    later[:-1] = near[1:] * ~last[:-1, None]
    return np.concatenate([np.ones((len(row), 1)), own, prior, later], axis=1), size, starts


@dataclass
class Model:
    """Weights of the line evidence (log-odds of good), transition scores, feature scaling, share of label 1."""
    weight: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    share: float
    fitted: bool

    def evidence(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -6, 6) @ self.weight

    def scores(self, col: pa.Array) -> np.ndarray:
        """Length-weighted mean marginal of the good label of every text."""
        if not self.fitted:
            return np.full(len(col), self.share)
        features, size, starts = line_features(col)
        good = forward_backward(self.evidence(features), starts, self.moves)[0][:, 1]
        weight = np.maximum(size, 1).astype(float)
        return np.add.reduceat(good * weight, starts[:-1]) / np.add.reduceat(weight, starts[:-1])


def forward_backward(evidence: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (lines, 2), expected transitions (2, 2) and log partition sum of all chains together."""
    lines = np.diff(starts)
    order = np.argsort(-lines, kind="stable")
    head, length = starts[:-1][order], lines[order]
    top = np.maximum(evidence, 0)
    local = np.exp(np.stack([-top, evidence - top], axis=1))
    step = np.exp(moves)
    alpha, beta = np.empty_like(local), np.ones_like(local)
    log_z = float(top.sum())
    active = len(length)
    for t in range(int(length[0]) if len(length) else 0):
        while length[active - 1] <= t:
            active -= 1
        at = head[:active] + t
        value = local[at] if t == 0 else local[at] * (alpha[at - 1] @ step)
        norm = value.sum(axis=1, keepdims=True)
        alpha[at] = value / norm
        log_z += float(np.log(norm).sum())
    pairs = np.zeros((2, 2))
    for t in range(int(length[0]) - 2 if len(length) else -1, -1, -1):
        active = int(np.searchsorted(-length, -(t + 1), side="left"))  # chains longer than t + 1
        at = head[:active] + t
        ahead = local[at + 1] * beta[at + 1]
        both = alpha[at][:, :, None] * step[None] * ahead[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        value = ahead @ step.T
        beta[at] = value / value.sum(axis=1, keepdims=True)
    marginal = alpha * beta
    return marginal / marginal.sum(axis=1, keepdims=True), pairs, log_z


def train(features: np.ndarray, starts: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.1,
          ridge: float = 0.002) -> Model:
    """Fit the field on whole documents; ``label``: 0 or 1 of each."""
    share = float(label.mean()) if len(label) else 0.5
    mean, scale = np.zeros(features.shape[1]), np.ones(features.shape[1])
    if len(features):
        mean[1:], scale[1:] = features[:, 1:].mean(axis=0), np.maximum(features[:, 1:].std(axis=0), 1e-3)
    model = Model(np.zeros(features.shape[1]), np.zeros((2, 2)), mean, scale, share, len(label) > 0 and 0 < share < 1)
    if not model.fitted:
        return model
    x = np.clip((features - mean) / scale, -6, 6)
    lines = np.diff(starts)
    y = np.repeat(label, lines).astype(float)
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = float((lines[label == k] - 1).sum())
    n = float(len(y))
    momentum, spread = np.zeros(len(model.weight) + 4), np.zeros(len(model.weight) + 4)
    for i in range(1, rounds + 1):
        marginal, pairs, _ = forward_backward(x @ model.weight, starts, model.moves)
        ascent = np.concatenate([x.T @ (y - marginal[:, 1]) / n - ridge * model.weight,
                                 ((seen - pairs) / n - ridge * model.moves).ravel()])
        momentum = 0.9 * momentum + 0.1 * ascent
        spread = 0.99 * spread + 0.01 * ascent**2
        move = rate * (momentum / (1 - 0.9**i)) / (np.sqrt(spread / (1 - 0.99**i)) + 1e-8) * min(1.0, 2 * (1 - i / (rounds + 1)))
        model.weight = model.weight + move[:-4]
        model.moves = model.moves + move[-4:].reshape(2, 2)
    return model


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that training never sees: crc32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix of all lines and the rows' line offsets, made some rows at a time."""
    parts, lines = [np.zeros((0, len(NAMES)))], [np.zeros(1, np.int64)]
    for lo, hi in row_slices(col, TRAIN_SLICE):
        features, _, starts = line_features(col.slice(lo, hi - lo))
        parts.append(features)
        lines.append(np.diff(starts))
    return np.concatenate(parts), np.cumsum(np.concatenate(lines))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                max_train: int = 3_000, max_train_chars: int = 8_000_000) -> Model:
    """Train on labelled documents that are not held out, taken by a hash of their id while they are at most ``max_train`` and have at
    most ``max_train_chars`` characters together; a document longer than all of that is not taken."""
    sample = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
              .filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
              .orderBy(F.xxhash64(F.col("id").cast("long")), "id", "label").limit(max_train))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), "id").withColumn("size", F.coalesce(F.length("text"), F.lit(0)).cast("long"))  # at most max_train ids
    by = Window.orderBy(F.xxhash64(F.col("id").cast("long")), "id", "label", "key").rowsBetween(Window.unboundedPreceding, 0)
    sized = found.filter(F.col("size") <= max_train_chars).select("id", "label", "size", F.xxhash64("text").alias("key"))
    sized = sized.orderBy(F.xxhash64(F.col("id").cast("long")), "id", "label", "key").limit(max_train)
    taken = sized.withColumn("run", F.sum("size").over(by)).filter(F.col("run") <= max_train_chars).select("id", "label", "key").distinct()
    rows = (found.withColumn("key", F.xxhash64("text")).join(F.broadcast(taken), ["id", "label", "key"])
            .orderBy("id", "label", "text").limit(max_train).select("text", "label").toArrow())
    label = np.asarray(rows["label"].to_numpy(), np.int64)
    if not len(label):
        return train(np.zeros((0, len(NAMES))), np.zeros(1, np.int64), label)
    return train(*_features(rows["text"].combine_chunks()), label)


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3, out: str = "quality_of_text") -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``out``: score (0 to 1) and predicted (0 or 1)."""
    spark = docs.sparkSession
    packed.limit_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # some hundred numbers
    names = docs.columns
    text = names.index(text_col)    # travels once, whatever else is carried
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    if docs.schema[text].dataType.simpleString() != "string":
        rows = rows.withColumn(f"c{text}", F.col(f"c{text}").cast("string"))
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_slices(batch.column(text), SLICE):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(part.column(text)), pa.float64())],
                                                 names=[*part.schema.names, "s"])

    done = rows.mapInArrow(score, f"{fields}, s double")
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
                       F.struct(F.col("s").alias("score"), (F.col("s") >= threshold).cast("int").alias("predicted")).alias(out))
