"""A small neural network (dense layers, ReLU, dropout, sigmoid) trained by synchronous mini-batches.

Rows are dealt by a hash of their key to ``PIECES`` pieces for each step of an epoch; every epoch draws the pieces of each mini-batch anew.
A step's gradient is the sum of the gradients of its rows, and one Adam step follows.  Over a table of blocks a piece is some partitions of
rows that the executors keep, and a step is a job of just the partitions of its pieces: an epoch reads the table once, not once a step.  An
epoch has rows / ``batch`` steps, at most ``max_steps``: on large tables mini-batches grow instead of the number of jobs.  Dropout masks come
from a hash of row, step and unit, so they do not depend on where a row lies; features are standardised with means and deviations of the table.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from storewatch.operators.blocks import Block, block_sum, mix, pack, uniform, unpack

PIECES = 4
TASKS_A_STEP = 16  # at most: each sends the driver a vector of all weights


@dataclass(frozen=True)
class Training:
    hidden: tuple = (128, 64)
    dropout: float = 0.2      # after the first hidden layer
    epochs: int = 10
    batch: int = 256
    max_steps: int = 200
    rate: float = 1e-3
    seed: int = 42


@dataclass
class Network:
    """Weights and offsets per layer, and the features' means and deviations."""
    layers: list
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, mask: np.ndarray | None = None) -> list:
        out = [(x - self.mean) / self.scale]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            if i + 1 < len(self.layers):
                z = np.maximum(z, 0.0)
                if i == 0 and mask is not None:
                    z = z * mask
            out.append(z)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.forward(x)[-1][:, 0]))


def flat(layers: list) -> np.ndarray:
    return np.concatenate([np.concatenate([w.reshape(-1), b]) for w, b in layers])


def shaped(vector: np.ndarray, like: list) -> list:
    out, at = [], 0
    for w, b in like:
        out.append((vector[at:at + w.size].reshape(w.shape), vector[at + w.size:at + w.size + b.size]))
        at += w.size + b.size
    return out


def first_layers(width: int, t: Training) -> list:
    """Uniform Glorot weights, zero offsets."""
    rng, sizes = np.random.default_rng(t.seed), (width, *t.hidden, 1)
    return [(rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]


def dropout_mask(h: np.ndarray, units: int, t: Training, step: int) -> np.ndarray:
    """0, or 1 / (1 - dropout), for each row and unit."""
    kept = uniform(mix(h[:, None] + np.arange(units, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), t.seed, step) >= t.dropout
    return kept / (1 - t.dropout)


def gradient(net: Network, x: np.ndarray, y: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """Gradient of the summed cross-entropy of the rows, all layers in one vector, and the loss and rows behind it."""
    out = net.forward(x, mask)
    z = out[-1][:, 0]
    loss = np.logaddexp(0, z) - y * z
    delta, grads = (1.0 / (1.0 + np.exp(-z)) - y)[:, None], []
    for i in range(len(net.layers) - 1, -1, -1):
        w, _ = net.layers[i]
        grads.append((out[i].T @ delta, delta.sum(axis=0)))
        if i:
            delta = (delta @ w.T) * (out[i] > 0)
            if i == 1 and mask is not None:
                delta = delta * mask
    return np.concatenate([flat(grads[::-1]), [loss.sum(), len(y)]])


def rows_gradient(net: Network, x: np.ndarray, y: np.ndarray, h: np.ndarray, t: Training, step: int) -> np.ndarray:
    """What rows of a mini-batch add to its step."""
    if not len(y):
        return np.zeros(flat(net.layers).size + 2)
    return gradient(net, x, y, dropout_mask(h, t.hidden[0], t, step) if t.dropout else None)


def piece_of(h: np.ndarray, steps: int, t: Training) -> np.ndarray:
    return (uniform(h, t.seed, 7) * (PIECES * steps)).astype(np.int64)


def pieces_of(epoch: int, steps: int, t: Training) -> np.ndarray:
    """The pieces of each mini-batch of an epoch."""
    return np.argsort(uniform(np.arange(PIECES * steps, dtype=np.uint64), t.seed, epoch, 8), kind="stable").reshape(steps, PIECES)


def moments(b: Block) -> np.ndarray:
    return np.concatenate([[len(b.y)], b.x.sum(axis=0), (b.x ** 2).sum(axis=0)])


class InTask:
    """Rows that lie in one task."""

    def __init__(self, block: Block, t: Training):
        self.b, self.t = block, t

    def moments(self) -> np.ndarray:
        return moments(self.b)

    def deal(self, steps: int) -> None:
        piece = piece_of(self.b.h, steps, self.t)
        self.order = np.argsort(piece, kind="stable")
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(piece, minlength=PIECES * steps))])

    def gradient(self, net: Network, pieces: np.ndarray, step: int) -> np.ndarray:
        rows = np.concatenate([self.order[self.ends[p]:self.ends[p + 1]] for p in pieces])
        return rows_gradient(net, self.b.x[rows], self.b.y[rows], self.b.h[rows], self.t, step)


class OverBlocks:
    """Rows of a table of blocks: each piece is ``parts`` partitions that the executors keep (memory, else disk)."""

    def __init__(self, blocks: DataFrame, width: int, t: Training):
        self.blocks, self.width, self.t, self.sc = blocks, width, t, blocks.sparkSession.sparkContext
        self.parts = max(1, min(self.sc.defaultParallelism, TASKS_A_STEP) // PIECES)
        self.kept = None

    def moments(self) -> np.ndarray:
        return block_sum(self.blocks, moments, 1 + 2 * self.width)

    def deal(self, steps: int) -> None:
        parts, t = self.parts, self.t

        def cut(row) -> Iterator[tuple]:
            b = Block.of(row.asDict())
            piece = piece_of(b.h, steps, t)
            order = np.argsort(piece, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
                yield int(piece[rows[0]]) * parts + b.bucket % parts, (b.bucket, b.h[rows], b.y[rows], pack(b.x[rows]))

        def join(found: Iterator[tuple]) -> Iterator[tuple]:
            rows = sorted((r for _, r in found), key=lambda r: r[0])
            if rows:
                x = np.concatenate([unpack(x, len(y)) for _, _, y, x in rows])
                yield np.concatenate([h for _, h, _, _ in rows]), np.concatenate([y for _, _, y, _ in rows]), pack(x)

        dealt = self.blocks.rdd.flatMap(cut).partitionBy(PIECES * steps * parts, lambda place: place)
        self.kept = dealt.mapPartitions(join).persist(StorageLevel.MEMORY_AND_DISK)

    def gradient(self, net: Network, pieces: np.ndarray, step: int) -> np.ndarray:
        t, size = self.t, flat(net.layers).size + 2

        def each(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
            for h, y, x in rows:
                yield rows_gradient(net, unpack(x, len(y)), y, h, t, step)

        places = [int(p) * self.parts + i for p in pieces for i in range(self.parts)]
        return sum(self.sc.runJob(self.kept, each, places), np.zeros(size))


def train(source: InTask | OverBlocks, width: int, t: Training) -> Network:
    """The training loop."""
    n, *m = source.moments()
    mean, square = np.array(m[:width]) / max(n, 1), np.array(m[width:]) / max(n, 1)
    scale = np.sqrt(np.maximum(square - mean ** 2, 0))
    net = Network(first_layers(width, t), mean, np.where(scale > 1e-9, scale, 1.0))
    steps = int(min(max(1, -(-n // t.batch)), t.max_steps))
    source.deal(steps)
    v = flat(net.layers)
    one, two = np.zeros_like(v), np.zeros_like(v)
    for epoch in range(t.epochs):
        for step, pieces in enumerate(pieces_of(epoch, steps, t), epoch * steps):
            *g, _, rows = source.gradient(net, pieces, step)
            g = np.array(g) / max(rows, 1)
            one, two = 0.9 * one + 0.1 * g, 0.999 * two + 0.001 * g * g
            v = v - t.rate * (one / (1 - 0.9 ** (step + 1))) / (np.sqrt(two / (1 - 0.999 ** (step + 1))) + 1e-7)
            net.layers = shaped(v, net.layers)
    return net


def train_block(block: Block, t: Training) -> Network:
    """On one block of rows."""
    return train(InTask(block, t), block.x.shape[1], t)


def train_in_task(blocks: list[dict], t: Training) -> Network:
    """On the blocks of a table whose features one task holds."""
    n = [r["n"] for r in blocks]
    h, y = (np.concatenate([np.frombuffer(r[c], kind) for r in blocks]) for c, kind in (("h", "<u8"), ("y", "<f8")))
    first = unpack(blocks[0]["x"], n[0])
    x, at = np.empty((sum(n), first.shape[1])), 0
    for r in blocks:
        x[at:at + r["n"]] = unpack(r["x"], r["n"])
        at += r["n"]
    return train_block(Block(0, h, x, y, None), t)


def train_blocks(blocks: DataFrame, width: int, t: Training) -> Network:
    """Over a table of blocks, a job a step of rows that the executors keep."""
    source = OverBlocks(blocks, width, t)
    try:
        return train(source, width, t)
    finally:
        if source.kept is not None:
            source.kept.unpersist()
