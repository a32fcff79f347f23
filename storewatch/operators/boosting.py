"""Boosted trees on binned features, grown best-first from gradient histograms.

Every feature is cut at quantiles into at most ``bins`` bins.  A tree starts with all (sampled) rows in one leaf; the leaf whose best
split gains most is split next, until ``leaves`` leaves.  A leaf's splits are judged on its histograms (sums of gradient, second
derivative and rows per bin).  They come from one aggregate over the table for many leaves at once, rows summed inside the tasks
first; only the smaller child of a split is summed, its sibling is the parent less it, and only rows on the way to a wanted leaf
move.  Leaves are expanded ahead of their turn in such waves, and the tree keeps the splits that best-first order takes, so waves
follow the depth, not the leaves.

Gradients are rounded to multiples of 2^-20 before they are summed: sums are then exact in any order, so reruns, other
partitions and the in-task path for a table of one block all give the same trees.

``gain`` is the usual second-order one: GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2); ties go to the first feature and bin.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.operators.blocks import Block, block_sum, distinct, keep, kept_sum, packed_columns, uniform

UNIT = float(1 << 20)
AHEAD = 16        # leaves that a wave over a table of blocks expands, if there are as many
KEEP_ROUNDS = 20  # trees between two written states of the kept blocks


@dataclass(frozen=True)
class Boosting:
    rounds: int
    rate: float
    leaves: int = 31
    depth: int | None = None
    min_rows: int = 1
    min_hessian: float = 0.0
    l2: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Splits (feature, bin: up to it goes left, children) and leaf values by node; a leaf has feature -1."""
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        todo = [(0, np.arange(len(bins)))]
        while todo:
            i, rows = todo.pop()
            if self.feature[i] < 0:
                node[rows] = i
            elif len(rows):
                goes = bins[rows, self.feature[i]] <= self.bin[i]
                todo += [(self.left[i], rows[goes]), (self.right[i], rows[~goes])]
        return node


@dataclass
class BoostedTrees:
    cuts: list
    start: float
    rate: float
    trees: list

    def predict(self, x: np.ndarray) -> np.ndarray:
        """P(y = 1) of rows of raw features."""
        bins = to_bins(x, self.cuts)
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += self.rate * tree.value[tree.leaf_of(bins)]
        return 1.0 / (1.0 + np.exp(-score))


def quantile_cuts(rows: DataFrame, width: int, x: str = "x", bins: int = 255) -> list:
    """Upper ends of each feature's bins but the last: its distinct quantiles, one aggregate for all features."""
    probs = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(x)[i], probs, 50_000).alias(f"q{i}") for i in range(width)]).first()
    tops = rows.agg(*[F.max(F.col(x)[i]).alias(f"m{i}") for i in range(width)]).first()
    return [np.array(sorted({v for v in (q or []) if v < top}), float) for q, top in zip(found, tops, strict=True)]


def bin_type(cuts: list) -> type:
    return np.uint8 if max((len(c) for c in cuts), default=0) < 256 else np.int16


def to_bins(x: np.ndarray, cuts: list) -> np.ndarray:
    """Bins by column: steps go over one feature at a time."""
    out = np.empty(x.shape, bin_type(cuts), order="F")
    for i, cut in enumerate(cuts):
        out[:, i] = np.searchsorted(cut, x[:, i], side="left")
    return out


class Grower:
    """One tree from a source of histograms: ``histograms(nodes, wanted) -> (wanted, bins, 3)``."""

    def __init__(self, cuts: list, p: Boosting, round_: int, histograms: Callable, ahead: int = 0, at_once: int | None = None):
        self.p, self.histograms, self.ahead, self.at_once = p, histograms, ahead, at_once
        width = np.array([len(c) + 1 for c in cuts])
        self.first = np.concatenate([[0], np.cumsum(width)])
        self.of = np.repeat(np.arange(len(cuts)), width)
        self.base = self.first[:-1][self.of]
        keep = max(1, int(round(p.column_share * len(cuts))))
        chosen = np.argsort(uniform(np.arange(len(cuts), dtype=np.uint64), p.seed, round_, 1), kind="stable")[:keep]
        self.chosen = chosen
        self.open = np.isin(self.of, chosen)
        self.open[self.first[1:] - 1] = False  # nothing is right of a feature's last bin

    def best(self, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gain, flat bin and left rows of the best split of each node (gain 0: none)."""
        run = np.cumsum(hist, axis=1)
        before = np.concatenate([np.zeros_like(run[:, :1]), run], axis=1)[:, self.base]
        left = run - before
        total = run[:, self.first[1] - 1][:, None]
        right = total - left
        score = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + self.p.l2, 1e-12)
        ok = self.open & (np.minimum(left[..., 2], right[..., 2]) >= max(self.p.min_rows, 1))
        ok &= np.minimum(left[..., 1], right[..., 1]) >= max(self.p.min_hessian, 1e-9)
        gain = np.where(ok, score(left) + score(right) - score(total), 0.0)
        at = np.argmax(gain, axis=1)
        pick = np.arange(len(hist))
        return gain[pick, at], at, left[pick, at, 2]

    def grow(self) -> Tree:
        hist = {0: self.histograms([(-1, 0, 0, 0)], [0])[0]}
        nodes, depth = [[-1, 0, 0, 0]], [0]                     # feature, bin, left, right
        self.nodes = nodes
        gain, at, rows_left = (list(v) for v in self.best(hist[0][None]))
        most = self.p.leaves if self.p.depth is None else min(self.p.leaves, 2 ** self.p.depth)
        while True:
            leaves, taken = [0], set()
            while len(leaves) < most:                            # best-first order over what is known
                top = max(leaves, key=lambda i: (gain[i], -i))
                if gain[top] <= 1e-9 or nodes[top][0] < 0:
                    break
                taken.add(top)
                leaves.remove(top)
                leaves += nodes[top][2:]
            if len(leaves) >= most or gain[max(leaves, key=lambda i: gain[i])] <= 1e-9:
                return self._tree(nodes, taken, hist)
            ready = sorted((i for i in leaves if gain[i] > 1e-9 and nodes[i][0] < 0), key=lambda i: (-gain[i], i))[:most - len(leaves)]
            ready = ready[:self.at_once]
            if len(ready) < self.ahead:  # a wave that is made anyway takes along what later ones may ask for
                rest = set(range(len(nodes))) - set(ready)
                ready += sorted((i for i in rest if gain[i] > 1e-9 and nodes[i][0] < 0), key=lambda i: (-gain[i], i))[:self.ahead - len(ready)]
            small = []
            for i in ready:
                nodes[i] = [int(self.of[at[i]]), int(at[i] - self.first[self.of[at[i]]]), len(nodes), len(nodes) + 1]
                nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
                depth += [depth[i] + 1] * 2
                small.append(nodes[i][2 if 2 * rows_left[i] <= hist[i][:self.first[1], 2].sum() else 3])
            for i, j, h in zip(ready, small, self.histograms([tuple(n) for n in nodes], small), strict=True):
                other = nodes[i][2] + nodes[i][3] - j
                hist[j], hist[other] = h, hist[i] - h
            new = [j for i in ready for j in nodes[i][2:]]
            for j, g, a, r in zip(new, *self.best(np.stack([hist[j] for j in new])), strict=True):
                gain.append(g if self.p.depth is None or depth[j] < self.p.depth else 0.0)
                at.append(a)
                rows_left.append(r)

    def _tree(self, nodes: list, taken: set, hist: dict) -> Tree:
        order, out = [0], []
        for i in order:
            order += nodes[i][2:] if i in taken else []
        place = {i: n for n, i in enumerate(order)}
        self.leaves = [(i, n) for i, n in place.items() if i not in taken]
        for i in order:
            g, h, _ = hist[i][:self.first[1]].sum(axis=0)
            f, b, lo, hi = nodes[i] if i in taken else (-1, 0, 0, 0)
            out.append((f, b, place.get(lo, 0), place.get(hi, 0), -(g / UNIT) / max(h / UNIT + self.p.l2, 1e-12)))
        f, b, lo, hi, v = zip(*out, strict=True)
        return Tree(np.array(f), np.array(b), np.array(lo), np.array(hi), np.array(v))


def block_histograms(bins: np.ndarray, y: np.ndarray, h: np.ndarray, score: np.ndarray, nodes: list, wanted: list, p: Boosting,
                     round_: int, first: np.ndarray) -> np.ndarray:
    """(wanted, bins, 3): sums of gradient, second derivative (in units of 2^-20) and rows of the sampled rows in the wanted nodes."""
    prob = 1.0 / (1.0 + np.exp(-score))
    g, w = np.rint((prob - y) * UNIT), np.rint(prob * (1 - prob) * UNIT)
    rows = np.flatnonzero(uniform(h, p.seed, round_) < p.row_share) if p.row_share < 1 else np.arange(len(y))
    slot = {n: i for i, n in enumerate(wanted)}
    parent = {child: i for i, (f, _, lo, hi) in enumerate(nodes) if f >= 0 for child in (lo, hi)}
    way = set()  # the wanted nodes and all above them: no other rows move
    for n in wanted:
        while n is not None and n not in way:
            way.add(n)
            n = parent.get(n)
    out = np.zeros((len(wanted), int(first[-1]), 3))
    todo = [(0, rows)]
    while todo:
        i, at = todo.pop()
        if i in slot:
            weights = g[at], w[at], None
            for j, (lo, hi) in enumerate(zip(first[:-1], first[1:], strict=True)):
                b = bins[at, j]
                for k, v in enumerate(weights):
                    out[slot[i], lo:hi, k] = np.bincount(b, weights=v, minlength=hi - lo)
            continue
        f, b, lo, hi = nodes[i]
        goes = bins[at, f] <= b
        todo += [(n, at[side]) for n, side in ((lo, goes), (hi, ~goes)) if n in way]
    return out


def _start(positives: float, n: float) -> float:
    share = min(max(positives / max(n, 1.0), 1e-6), 1 - 1e-6)
    return float(np.log(share / (1 - share)))


class RowsInTask:
    """Histograms of rows that lie in one task: every node's rows are kept, so only the rows of a wanted node are read.  Features of two bins of
    which at most one is in its upper bin in a row (one-hot slots) are counted together, as one code."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, h: np.ndarray, cuts: list, p: Boosting):
        self.bins, self.y, self.h, self.p = bins, y, h, p
        self.first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])
        self.alone, self.sets = [], []
        for j, cut in enumerate(cuts):
            upper = bins[:, j] > 0
            into = next((s for s in self.sets if len(cut) == 1 and len(s[0]) < 250 and not s[1][upper].any()), None)
            if into is not None:
                into[0].append(j)
                into[1][upper] = len(into[0])
            elif len(cut) == 1:
                self.sets.append(([j], upper.astype(np.uint8)))
            else:
                self.alone.append(j)

    def start(self, score: np.ndarray, round_: int) -> None:
        """A tree on the gradients of ``score``."""
        prob = 1.0 / (1.0 + np.exp(-score))
        self.g, self.w = np.rint((prob - self.y) * UNIT), np.rint(prob * (1 - prob) * UNIT)
        taken = uniform(self.h, self.p.seed, round_) < self.p.row_share if self.p.row_share < 1 else np.ones(len(self.y), bool)
        self.left_out = np.flatnonzero(~taken)
        self.rows, self.round = {0: np.flatnonzero(taken).astype(np.int32)}, round_

    def rows_of(self, node: int, nodes: list) -> np.ndarray:
        if node not in self.rows:
            parent = next(i for i, n in enumerate(nodes) if n[0] >= 0 and node in n[2:])
            f, b, lo, hi = nodes[parent]
            at = self.rows_of(parent, nodes)
            goes = self.bins[:, f][at] <= b
            self.rows[lo], self.rows[hi] = at[goes], at[~goes]
        return self.rows[node]

    def histograms(self, nodes: list, wanted: list, chosen: np.ndarray) -> np.ndarray:
        """As :func:`block_histograms`; features that the tree does not use are left out, but for the first, which gives the totals."""
        out = np.zeros((len(wanted), int(self.first[-1]), 3))
        used = {0, *chosen.tolist()}
        for i, node in enumerate(wanted):
            at = self.rows_of(node, nodes)
            everything = len(at) == len(self.y)
            weights = [self.g, self.w] if everything else [self.g[at], self.w[at]]
            total = np.array([weights[0].sum(), weights[1].sum(), len(at)])
            count = lambda code, n: np.stack([*(np.bincount(code, v, n) for v in weights), np.bincount(code, minlength=n)], axis=1)  # noqa: E731, B023
            for j in used.intersection(self.alone):
                column = self.bins[:, j]
                out[i, self.first[j]:self.first[j + 1]] = count((column if everything else column[at]).astype(np.intp), self.first[j + 1] - self.first[j])
            for members, code in self.sets:
                if used.intersection(members):
                    upper = count((code if everything else code[at]).astype(np.intp), len(members) + 1)[1:]
                    out[i, self.first[members]], out[i, self.first[members] + 1] = total - upper, upper
        return out

    def add(self, score: np.ndarray, tree: Tree, grower: Grower, nodes: list) -> None:
        """Add a grown tree to the scores."""
        for i, place in grower.leaves:
            score[self.rows_of(i, nodes)] += self.p.rate * tree.value[place]
        if len(self.left_out):
            score[self.left_out] += self.p.rate * tree.value[tree.leaf_of(self.bins[self.left_out])]


def boost_rows(bins: np.ndarray, y: np.ndarray, h: np.ndarray, cuts: list, p: Boosting) -> BoostedTrees:
    """All rounds on rows that lie in one task; ``bins`` by column (:func:`to_bins`)."""
    model = BoostedTrees(cuts, _start(y.sum(), len(y)), p.rate, [])
    score = np.full(len(y), model.start)
    rows = RowsInTask(bins, y, h, cuts, p)
    for r in range(p.rounds):
        rows.start(score, r)
        grower = Grower(cuts, p, r, lambda nodes, wanted: rows.histograms(nodes, wanted, grower.chosen), at_once=1)  # noqa: B023
        model.trees.append(grower.grow())
        rows.add(score, model.trees[-1], grower, grower.nodes)
    return model


def boost_block(block: Block, cuts: list, p: Boosting) -> BoostedTrees:
    """All rounds on one block of rows."""
    return boost_rows(to_bins(block.x, cuts), block.y, block.h, cuts, p)


def boost_in_task(blocks: list[dict], cuts: list, p: Boosting) -> BoostedTrees:
    """All rounds on the blocks of a table that one task holds: a byte a feature, and some 60 bytes a row for labels, hashes and scores."""
    y, h = (np.concatenate([np.frombuffer(r[c], t) for r in blocks]) for c, t in (("y", "<f8"), ("h", "<u8")))
    bins = np.empty((len(y), len(cuts)), bin_type(cuts), order="F")
    at = 0
    for r in blocks:
        for j, column in enumerate(packed_columns(r["x"])):
            values, codes = distinct(column, r["n"])
            bins[at:at + r["n"], j] = np.searchsorted(cuts[j], values, side="left").astype(bins.dtype)[codes]
        at += r["n"]
    return boost_rows(bins, y, h, cuts, p)


def boost_blocks(blocks: DataFrame, cuts: list, p: Boosting) -> BoostedTrees:
    """All rounds over a table of blocks: one aggregate per wave of splits.  Bins and scores stay with the executors; a round's first
    aggregate adds the tree before it to the scores.  They are written every KEEP_ROUNDS rounds, so lineage stays short."""
    first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])
    sc = blocks.sparkSession.sparkContext
    n, positives = block_sum(blocks, lambda b: np.array([len(b.y), b.y.sum()]), 2)
    model = BoostedTrees(cuts, _start(positives, n), p.rate, [])
    start = model.start
    kept = keep(blocks, lambda b: (to_bins(b.x, cuts), b.y, b.h, np.full(len(b.y), start)))
    older = None
    for r in range(p.rounds):
        def histograms(nodes: list, wanted: list, r: int = r, kept: RDD = kept) -> np.ndarray:
            step = lambda k: block_histograms(k[0], k[1], k[2], k[3], nodes, wanted, p, r, first)
            return kept_sum(kept, step, len(wanted) * int(first[-1]) * 3).reshape(len(wanted), -1, 3)

        model.trees.append(Grower(cuts, p, r, histograms, AHEAD).grow())
        if older is not None:
            older.unpersist()
        older = kept
        if r + 1 < p.rounds:
            tree, rate = model.trees[-1], p.rate
            kept = kept.map(lambda k, tree=tree: (k[0], k[1], k[2], k[3] + rate * tree.value[tree.leaf_of(k[0])]))
            kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
            if (r + 1) % KEEP_ROUNDS == 0 and sc.getCheckpointDir():
                kept.checkpoint()
    kept.unpersist()
    return model
