"""Random forest of fully grown trees.

Every tree sees a Poisson bootstrap of the whole table: in each block the number of draws is Poisson with one draw a row, the rows
are drawn with replacement.  Trees grow without a depth limit: Gini impurity, classes weighted alike, a random subset of features at every
node.  Such trees are as large as the table, so they are neither collected nor sent to the rows that they score: a task receives all
rows by column (``pack``ed; numbers become ranks, one-hot slots of one kind a code) and, for each tree of its group, sends the drawn rows
and all others down together, a level of nodes at a time (:class:`Level`), until every row has its leaf.  What leaves the
task is the sum over its trees for each row.  A task holds some 50 bytes a row of the table, and as much again for the tree in hand.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.operators.blocks import Block, distinct, is_bits, key_texts, limit_batches, packed_columns

CHUNK_NODES = 1 << 14   # nodes whose features are drawn and compared together
CHUNK_PAIRS = 1 << 20   # rows of the (node, feature) pairs that are sorted together
REST = -1               # buckets of rows that are only scored: REST, REST - 1, ...


@dataclass
class GiniTree:
    """Splits (feature, threshold: up to it goes left, children) and P(y = 1) by node; a leaf has feature -1."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[self.feature[node[rows]] >= 0]
            at = node[rows]
            node[rows] = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.share[node]


@dataclass
class Forest:
    trees: list

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum(t.predict(x) for t in self.trees) / len(self.trees)


def best_split(v: np.ndarray, w: np.ndarray, pos: np.ndarray) -> tuple[float, float]:
    """Weighted impurity that is left by the best cut of one feature, and the cut (halfway between two values)."""
    order = np.argsort(v, kind="stable")
    v, lw, lp = v[order], np.cumsum(w[order]), np.cumsum(pos[order])
    cut = np.flatnonzero(v[1:] > v[:-1])
    if not len(cut):
        return np.inf, 0.0
    a, b, p, q = lw[cut], lw[-1] - lw[cut], lp[cut], lp[-1] - lp[cut]
    left = p * (a - p) / a + q * (b - q) / b
    i = int(np.argmin(left))
    middle = (v[cut[i]] + v[cut[i] + 1]) / 2
    return float(left[i]), float(middle if middle < v[cut[i] + 1] else v[cut[i]])


def grow_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> GiniTree:
    """A tree of pure leaves (or of rows that no feature tells apart).  Each node tries the features in random order until it
    has tried sqrt(width) of them and found a cut."""
    tries = max(1, int(np.sqrt(x.shape[1])))
    out = [[-1, 0.0, 0, 0, 0.0]]
    todo = [(0, np.arange(len(y)))]
    while todo:
        me, rows = todo.pop()
        pos = w[rows] * y[rows]
        total = w[rows].sum()
        out[me][4] = float(pos.sum() / total)
        if y[rows].min() == y[rows].max():
            continue
        best = (np.inf, 0.0, -1)
        for n, f in enumerate(rng.permutation(x.shape[1])):
            if n >= tries and best[2] >= 0:
                break
            left, at = best_split(x[rows, f], w[rows], pos)
            if left < best[0]:
                best = (left, at, int(f))
        if best[2] < 0:
            continue
        goes = x[rows, best[2]] <= best[1]
        out[me][:4] = [best[2], best[1], len(out), len(out) + 1]
        todo += [(len(out) + 1, rows[~goes]), (len(out), rows[goes])]
        out += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
    f, t, lo, hi, s = zip(*out, strict=True)
    return GiniTree(np.array(f), np.array(t), np.array(lo), np.array(hi), np.array(s))


def draw(seed: int, bucket: int, tree: int, n: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block that a tree's bootstrap draws, and how often."""
    rng = np.random.default_rng([seed, bucket, tree])
    return np.unique(rng.integers(0, n, rng.poisson(share * n)), return_counts=True)


class Rows:
    """A table by column: numbers as ranks among their distinct values, columns of 0 and 1 of which at most one is 1 in a row as one code."""

    def __init__(self, pieces: Iterator[tuple[int, int, bytes, int]]):
        """``pieces``: column, bucket, packed column and rows, by column and then by bucket."""
        self.values: list[np.ndarray] = []       # distinct values of each number
        self.members: list[list[int]] = []       # features of each code, code 1 first
        codes: list[np.ndarray] = []
        numbers, sets = [], []
        self.width = 0
        for j, found in groupby(pieces, key=lambda p: p[0]):
            parts = [(c, n) for _, _, c, n in found]
            self.width = j + 1
            if all(is_bits(c) for c, _ in parts):
                self._add_set(sets, j, np.concatenate([distinct(c, n)[1] for c, n in parts]).view(bool))
                continue
            split = [distinct(c, n) for c, n in parts]
            values = np.unique(np.concatenate([v for v, _ in split]))
            numbers.append((j, values, np.concatenate([np.searchsorted(values, v).astype(np.int32)[at] for v, at in split])))
        self.features = np.array([j for j, _, _ in numbers], int)
        self.values = [v for _, v, _ in numbers]
        codes = [c for _, _, c in numbers]
        while sets:
            members, code = sets.pop(0)
            self.members.append(members)
            codes.append(code.astype(np.int32))
        numbers.clear()
        self.codes = np.stack(codes, axis=1) if codes else np.zeros((0, 0), np.int32)
        # of each feature: its column of codes, and the code that means 1 (0: a number)
        self.column, self.one = np.zeros(self.width, int), np.zeros(self.width, np.int32)
        self.column[self.features] = np.arange(len(self.features))
        for k, members in enumerate(self.members):
            self.column[members], self.one[members] = len(self.features) + k, np.arange(1, len(members) + 1)

    def code(self, rows: np.ndarray, column: np.ndarray | int) -> np.ndarray:
        """Codes of rows in a column, or in a column for each."""
        return self.codes.ravel().take(rows.astype(np.int64) * self.codes.shape[1] + column)

    @staticmethod
    def _add_set(sets: list, j: int, ones: np.ndarray) -> None:
        for members, code in sets:
            if len(members) < 250 and not code[ones].any():
                members.append(j)
                code[ones] = len(members)
                return
        sets.append(([j], ones.astype(np.uint8)))


def counts(at: np.ndarray, pay: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws of label 1 and of label 0 at each place (``pay``: see :class:`Level`)."""
    if len(pay) < 1 << 25:  # one pass: a sum of doubles holds both exactly
        made = np.bincount(at, (pay >> 1) * np.where(pay & 1, float(1 << 26), 1.0), size)
        p = np.floor(made / float(1 << 26))
        return p, made - p * float(1 << 26)
    return np.bincount(at, (pay >> 1) * ((pay & 1) > 0), size), np.bincount(at, (pay >> 1) * ((pay & 1) == 0), size)


class Level:
    """Best splits of some nodes of one tree, all worked out together.

    ``rows``: the drawn rows, node by node; ``size``: how many of each node; ``pay``: of every row of the table twice the draws, plus one
    if its label is 1.  The numbers that a node tries are sorted with the node, as one word of node, rank and ``pay``."""

    def __init__(self, table: Rows, rows: np.ndarray, size: np.ndarray, pay: np.ndarray, weight: tuple[float, float], tries: int, rng: np.random.Generator):
        self.t, self.rows, self.size, self.pay, self.weight = table, rows, size, pay, weight
        self.start = np.cumsum(size) - size
        self.node = np.repeat(np.arange(len(size)), size)
        paid = pay[rows]
        self.p, self.n = counts(self.node, paid, len(size))
        self.order = np.argsort(rng.random((len(size), table.width)), axis=1)
        self.left = np.full((len(size), table.width), np.inf)     # impurity that a feature's best cut leaves
        self.cut = np.zeros((len(size), table.width), np.int32)   # numbers: the last rank that goes left
        self.next = np.zeros((len(size), table.width), np.int32)  # and the first that goes right
        self.counts = {}
        for k, members in enumerate(table.members):
            at = self.node * (len(members) + 1) + table.code(rows, len(table.features) + k)
            self.counts[k] = [v.reshape(len(size), -1)[:, 1:] for v in counts(at, paid, len(size) * (len(members) + 1))]
        first = np.zeros((len(size), table.width), bool)
        np.put_along_axis(first, self.order[:, :tries], True, axis=1)
        self._try(first)
        none = np.flatnonzero(~np.isfinite(self.left).any(axis=1))
        if len(none):  # the next feature in the node's order that tells its rows apart
            apart = self._apart(none)
            has = np.flatnonzero(apart.any(axis=1))
            pick = self.order[none[has], np.argmax(np.take_along_axis(apart[has], self.order[none[has]], axis=1), axis=1)]
            more = np.zeros_like(first)
            more[none[has], pick] = True
            self._try(more)
        place = np.argmin(np.take_along_axis(self.left, self.order, axis=1), axis=1)
        self.feature = self.order[np.arange(len(size)), place]
        self.found = np.isfinite(self.left[np.arange(len(size)), self.feature])

    def impurity(self, p1, n1, p2, n2) -> np.ndarray:
        wn, wp = self.weight
        p1, n1, p2, n2 = wp * p1, wn * n1, wp * p2, wn * n2
        return p1 * n1 / (p1 + n1) + p2 * n2 / (p2 + n2)

    def _try(self, wanted: np.ndarray) -> None:
        t = self.t
        for k, members in enumerate(t.members):
            p, n = self.counts[k]
            at, m = np.nonzero(wanted[:, members])
            p, n = p[at, m], n[at, m]
            p0, n0 = self.p[at] - p, self.n[at] - n
            ok = (p + n > 0) & (p0 + n0 > 0)
            self.left[at[ok], np.array(members)[m[ok]]] = self.impurity(p0[ok], n0[ok], p[ok], n[ok])
        at, f = np.nonzero(wanted[:, t.features]) if len(t.features) else ((), ())
        if len(at):
            done = np.cumsum(self.size[at])
            edges = [0]
            while edges[-1] < len(at):
                before = done[edges[-1] - 1] if edges[-1] else 0
                edges.append(max(edges[-1] + 1, int(np.searchsorted(done, before + CHUNK_PAIRS, "right"))))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                self._numbers(at[lo:hi], f[lo:hi])

    def _numbers(self, at: np.ndarray, f: np.ndarray) -> None:
        """The best cuts of pairs of a node and a number."""
        size = self.size[at]
        end = np.cumsum(size)
        pair = np.repeat(np.arange(len(at)), size)
        rows = self.rows[np.arange(end[-1]) + np.repeat(self.start[at] - (end - size), size)]
        word = pair.astype(np.uint64) << np.uint64(40)
        word |= self.t.code(rows, f[pair]).astype(np.uint64) << np.uint64(8)
        word |= self.pay[rows]
        word.sort()
        draws = ((word & np.uint64(255)) >> np.uint64(1)).astype(np.int64)
        positive = draws * (word & np.uint64(1)).astype(np.int64)
        p, both = np.cumsum(positive), np.cumsum(draws)
        word >>= np.uint64(8)
        edge = np.flatnonzero(word[1:] != word[:-1])
        edge = edge[pair[edge] == pair[edge + 1]]   # sorted words lie pair by pair, as before
        if not len(edge):
            return
        of = pair[edge]
        p0, b0 = (np.concatenate([[0], v])[(end - size)[of]] for v in (p, both))
        p1 = (p[edge] - p0).astype(float)
        n1 = (both[edge] - b0) - p1
        left = self.impurity(p1, n1, self.p[at[of]] - p1, self.n[at[of]] - n1)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        least = np.minimum.reduceat(left, starts)
        best = np.flatnonzero(left == np.repeat(least, np.diff(np.append(starts, len(of)))))
        best = best[np.diff(of[best], prepend=-1) > 0]   # the first of each pair
        node, feature = at[of[best]], self.t.features[f[of[best]]]
        rank = np.uint64((1 << 32) - 1)
        self.left[node, feature] = left[best]
        self.cut[node, feature] = word[edge[best]] & rank
        self.next[node, feature] = word[edge[best] + 1] & rank

    def _apart(self, nodes: np.ndarray) -> np.ndarray:
        """Whether a feature has more than one value among a node's drawn rows."""
        out = np.zeros((len(nodes), self.t.width), bool)
        for k, members in enumerate(self.t.members):
            ones = (self.counts[k][0] + self.counts[k][1])[nodes]
            out[:, members] = (ones > 0) & (ones < (self.p + self.n)[nodes, None])
        size = self.size[nodes]
        end = np.cumsum(size)
        rows = self.rows[np.arange(end[-1]) + np.repeat(self.start[nodes] - (end - size), size)]
        for j, feature in enumerate(self.t.features):
            code = self.t.code(rows, j)
            out[:, feature] = np.maximum.reduceat(code, end - size) > np.minimum.reduceat(code, end - size)
        return out

    def thresholds(self) -> np.ndarray:
        """The last rank that goes left of each node's split, by the middle between the values of the two drawn rows next to the cut."""
        out = np.zeros(len(self.size), np.int32)
        for j, feature in enumerate(self.t.features):
            at, values = np.flatnonzero(self.found & (self.feature == feature)), self.t.values[j]
            a, b = values[self.cut[at, feature]], values[self.next[at, feature]]
            middle = (a + b) / 2
            out[at] = np.searchsorted(values, np.where(middle < b, middle, a), "right") - 1
        return out


def grow_and_score(table: Rows, pay: np.ndarray, weight: tuple[float, float], rng: np.random.Generator, total: np.ndarray, tries: int | None = None) -> None:
    """Grow a tree on the drawn rows (see :class:`Level`) and add P(y = 1) of every row's leaf to ``total``."""
    tries = tries or max(1, int(np.sqrt(table.width)))
    rows = np.flatnonzero(pay >> 1).astype(np.int32)
    others = np.flatnonzero(pay >> 1 == 0).astype(np.int32)
    if not len(rows):
        return
    of_row, of_other = np.zeros(len(rows), np.int64), np.zeros(len(others), np.int64)
    nodes = 1
    while True:
        p, n = counts(of_row, pay[rows], nodes)
        share = p * weight[1] / (p * weight[1] + n * weight[0])
        mixed = (p > 0) & (n > 0)
        size = np.bincount(of_row, minlength=nodes)
        split = {"feature": np.zeros(nodes, int), "at": np.zeros(nodes, np.int32), "ok": np.zeros(nodes, bool)}
        open_nodes = np.flatnonzero(mixed)
        live = rows[mixed[of_row]]
        ends = np.cumsum(size[open_nodes])
        for lo in range(0, len(open_nodes), CHUNK_NODES):
            some = open_nodes[lo:lo + CHUNK_NODES]
            part = live[ends[lo] - size[some[0]]:ends[lo + len(some) - 1]]
            level = Level(table, part, size[some], pay, weight, tries, rng)
            split["feature"][some], split["at"][some], split["ok"][some] = level.feature, level.thresholds(), level.found
        ok = split["ok"]
        for at, of in ((rows, of_row), (others, of_other)):
            ends_here = ~ok[of]
            total[at[ends_here]] += share[of[ends_here]]
        if not ok.any():
            return
        place = np.cumsum(ok) - 1
        column, one, child = table.column[split["feature"]], table.one[split["feature"]], (2 * place).astype(np.uint64) << np.uint64(32)
        moved = []
        for at, of in ((rows, of_row), (others, of_other)):
            goes_on = ok[of]
            at, of = at[goes_on], of[goes_on]
            code, of_one = table.code(at, column[of]), one[of]
            right = np.where(of_one > 0, code == of_one, code > split["at"][of])
            word = child[of] | at.astype(np.uint64)
            word[right] |= np.uint64(1 << 32)
            word.sort()
            moved += [(word & np.uint64((1 << 32) - 1)).astype(np.int32), (word >> np.uint64(32)).astype(np.int64)]
        rows, of_row, others, of_other = moved
        nodes = 2 * int(ok.sum())


def draws_of(seed: int, bucket: int, tree: int, n: int) -> np.ndarray:
    """How often a tree's bootstrap draws each row of a block."""
    rows, times = draw(seed, bucket, tree, n, 1.0)
    out = np.zeros(n, np.uint8)
    out[rows] = np.minimum(times, 127)  # 127 draws of one row: never, by chance
    return out


def _spread_labels(blocks: DataFrame, groups: int) -> list[int]:
    """Numbers that Spark's hash partitioning into ``groups`` sends to 0, 1, 2 ...: every group has a task of its own."""
    found: dict = {}
    tried = 64 * groups
    while len(found) < groups:
        label = F.col("id").cast("int")
        for r in blocks.sparkSession.range(tried).select(label.alias("label"), F.pmod(F.hash(label), F.lit(groups)).alias("at")).collect():
            found.setdefault(r["at"], r["label"])
        tried *= 4
    return [found[g] for g in range(groups)]


def forest_scores(blocks: DataFrame, n_trees: int = 400, seed: int = 42, groups: int | None = None) -> DataFrame:
    """P(y = 1) of every row of ``blocks`` (``to_blocks`` with texts): the key's JSON ``k`` and ``score``.  Blocks with a bucket below 0 are not
    learned from."""
    spark = blocks.sparkSession
    limit_batches(spark)
    groups = min(n_trees, groups or spark.sparkContext.defaultParallelism)
    labels = _spread_labels(blocks, groups)

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = packed_columns(row["x"])
                label = np.frombuffer(row["y"], "<f8") > 0
                pieces = [(-1, np.packbits(label).tobytes()), *enumerate(columns)]
                yield pa.RecordBatch.from_pydict({"j": pa.array([j for j, _ in pieces], pa.int32()), "bucket": pa.array([row["bucket"]] * len(pieces), pa.int32()),
                                                  "n": pa.array([row["n"]] * len(pieces), pa.int32()), "data": pa.array([c for _, c in pieces], pa.binary())})

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in batch.to_pylist())
        head = next(stream, None)
        if head is None:
            return
        group = labels.index(head["label"])
        of_blocks: list[tuple[int, int]] = []
        y: list[np.ndarray] = []
        row: dict | None = head
        while row is not None and row["j"] < 0:
            of_blocks.append((row["bucket"], row["n"]))
            y.append(np.unpackbits(np.frombuffer(row["data"], np.uint8), count=row["n"]))
            row = next(stream, None)
        table = Rows((r["j"], r["bucket"], r["data"], r["n"]) for r in chain([row] if row else [], stream))
        label = np.concatenate(y)
        learned = np.concatenate([np.full(n, b >= 0) for b, n in of_blocks])
        n = int(learned.sum())
        positives = int(label[learned].sum())
        weight = (n / (2 * max(n - positives, 1)), n / (2 * max(positives, 1)))
        total, made = np.zeros(len(label)), 0
        for t in range(group, n_trees, groups):
            drawn = np.concatenate([draws_of(seed, b, t, n) if b >= 0 else np.zeros(n, np.uint8) for b, n in of_blocks])
            if drawn.any():
                made += 1
                grow_and_score(table, (drawn << 1) | label, weight, np.random.default_rng([seed, t]), total)
        at = 0
        for b, n in of_blocks:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "group": pa.array([group], pa.int32()), "n": pa.array([made], pa.int32()),
                                              "data": pa.array([total[at:at + n].tobytes()], pa.binary())})
            at += n

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, total, trees = None, None, 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"k": pa.array(key_texts(texts), pa.string()), "score": pa.array(total / max(trees, 1), pa.float64())})

        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] < 0:
                    if texts is not None:
                        yield rows()
                    texts, total, trees = row["data"], 0.0, 0
                else:
                    total, trees = total + np.frombuffer(row["data"], "<f8"), trees + row["n"]
        if texts is not None:
            yield rows()

    pieces = blocks.select("bucket", "n", "x", "y").mapInArrow(take_apart, "j int, bucket int, n int, data binary")
    pieces = pieces.withColumn("label", F.explode(F.array(*[F.lit(v) for v in labels]))).repartition(groups, "label")
    sums = pieces.sortWithinPartitions("j", "bucket").mapInArrow(grow, "bucket int, group int, n int, data binary")
    named = blocks.select("bucket", F.lit(-1).alias("group"), "n", F.col("texts").alias("data"))
    return sums.unionByName(named).repartition("bucket").sortWithinPartitions("bucket", "group").mapInArrow(add, "k string, score double")


def fit_forest(blocks: DataFrame, n_trees: int = 400, seed: int = 42) -> Forest:
    """The trees themselves, grown one node at a time on the same bootstraps, for tables whose trees the driver can hold;
    :func:`forest_scores` scores with a forest of any size."""
    rows = [Block.of(r.asDict()) for r in blocks.sort("bucket").collect()]
    x, y = np.concatenate([b.x for b in rows]), np.concatenate([b.y for b in rows])
    weight = (len(y) / (2 * max(len(y) - y.sum(), 1)), len(y) / (2 * max(y.sum(), 1)))
    trees = []
    for t in range(n_trees):
        times = np.concatenate([draws_of(seed, b.bucket, t, len(b.y)) for b in rows])
        at = np.flatnonzero(times)
        if len(at):
            trees.append(grow_tree(x[at], y[at], times[at] * np.where(y[at] > 0, weight[1], weight[0]), np.random.default_rng([seed, t])))
    return Forest(trees)
