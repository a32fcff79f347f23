"""Prefix trie of conversations, summed up by the Euler-tour technique.

Conversations are sequences of (role, text) turns; each distinct sequence of their first d turns is a node at depth d, from
the root at 0.  A node is named by its smallest member and its depth, so the nodes that a conversation names lie on one
vertical path, and other paths hang on its nodes.

1. *Sequences.*  Turns become 128-bit hashes with their text's code points, one read of the texts.  They are sorted by range
   partitions of (conversation, turn); partition borders carry row numbers and sums on, so one conversation may span many
   tasks.  A prefix is named by the sum of the hashes of its (position, turn) pairs.
2. *Nodes.*  One aggregate over all prefixes (with map-side combine) gives smallest member, members and text size.
3. *Arcs.*  Each node has an enter and an exit arc.  Enter is followed by the enter arc of the first child (by smallest
   member) or by the node's exit; exit by the enter arc of the next sibling or by the parent's exit.  Next siblings come from
   range partitions of (parent, child) with the first row of the partition after, so a node may have any number of children.
4. *List ranking.*  Tasks hold arcs of neighbouring nodes of a path and contract runs of successors among them to one element with
   the run's weights (arcs, leaves, savings).  Then rounds of random mates: an element that draws tails is dealt to its
   successor's task, one that draws heads to its own, and runs that meet are contracted, a quarter of all elements a round.  Once at most
   ``base`` elements are left, one task ranks them; the rounds are unwound by joins.  Every arc then has the
   sums over all arcs before it.
5. *Subtrees.*  Leaves and savings of a subtree are the prefix sum at the exit arc less that at the enter arc.

Conversations may begin with turns of another one (:func:`rebuilt` in the query): ``heads`` takes the first turns of some
conversations, at most a few each.  Digests of the members that end at a node are streamed over sorted chunks of ids.

Scale: everything after the first read is narrow rows; each contraction task holds its share of arcs; nothing is collected
but one row per partition (borders) and element counts.

Defined cases: null role or text is empty; null turns come first, and rows of one turn go by role, then by the md5 of the text; repeated
rows are turns of their own; rows without a conversation id are left out; a conversation may be rebuilt to no turn and is then
a member of the root alone; an empty table gives no node; other columns are not read.  128-bit hashes stand for turns and
prefixes (md5, and sums of mixed md5 halves).
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storewatch.llm.packed import partitions
from storewatch.llm.words import mix
from storewatch.session import Scope, cut_lineage

BASE = 1 << 16          # elements that one task ranks
HEAD_TURNS = 5          # turns that a conversation can begin with, at most
SHARE = 1 << 18         # rows that a task contracts at a time


def borrowed_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (HEAD_TURNS + 1)).cast("int")


def narrow_turns(rows: DataFrame) -> DataFrame:
    """conv, turn, role, code (md5 of the text), k1, k2 (128-bit hash of role and text), chars of every turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                                    role.alias("role"), F.md5(text.cast("binary")).alias("code"), F.char_length(text).cast("long").alias("chars"))
    both = F.md5(F.concat(F.md5(F.col("role").cast("binary")), F.col("code")).cast("binary"))
    return rows.withColumns({"k1": F.xxhash64(both), "k2": F.xxhash64(F.lit(7), both)})


def _held_back(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """The batches that have rows, each with whether it is the partition's last."""
    held = None
    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield held, False
            held = batch
    if held is not None:
        yield held, True


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def running_sums(rows: DataFrame, order: list[str], sums: list[str], parts: int, scope: Scope) -> DataFrame:
    """``rows`` with ``<s>_run`` for each long column of ``sums``: its sum (64 bits, wrapping) over the conversation's rows up to
    this one in the given order, and ``<s>_old``, without this one.  Rows lie in range partitions; the sums at each partition's end are carried on, one row per partition."""
    before = [F.col(c).asc_nulls_first() for c in ("conv", *order)]
    names = rows.columns
    out = _ddl(rows) + "".join(f", {s}_run long" for s in sums) + ", part int, ends boolean"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, carry = TaskContext.get().partitionId(), None, [np.int64(0)] * len(sums)
        for batch, last in _held_back(batches):
            conv = np.asarray(batch.column("conv"))
            begin = np.concatenate([[True], conv[1:] != conv[:-1]])
            segment = np.cumsum(begin) - 1
            made = {n: batch.column(n) for n in names}
            for i, s in enumerate(sums):
                run = np.cumsum(np.asarray(batch.column(s)), dtype=np.int64)
                base = np.concatenate([[0], run[:-1]])[begin]
                if conv[0] == key:
                    base[0] -= carry[i]
                made[f"{s}_run"] = run - base[segment]
                carry[i] = made[f"{s}_run"][-1]
            key = conv[-1]
            made["part"] = np.full(len(conv), part, np.int32)
            made["ends"] = np.arange(len(conv)) == (len(conv) - 1 if last else -1)
            yield pa.RecordBatch.from_pydict(made)

    made = scope.table(rows.repartitionByRange(parts, *before).sortWithinPartitions(*before).mapInArrow(local, out))
    carried, key, total = {}, None, [0] * len(sums)
    for r in sorted(made.where("ends").select("part", "conv", *[f"{s}_run" for s in sums]).collect()):  # one row per partition
        if key is not None:
            carried[r.part] = (key, total)
        # the partition's own end has what came before only if its last conversation began in an earlier partition
        known = made_before(carried.get(r.part), r.conv, len(sums))
        key, total = r.conv, [(a + b + 2**63) % 2**64 - 2**63 for a, b in zip(known, r[2:], strict=True)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, part = np.asarray(batch.column("conv")), np.asarray(batch.column("part"))
            made = {n: batch.column(n) for n in names}
            runs = [np.array(batch.column(f"{s}_run")) for s in sums]
            for p in np.unique(part):
                if int(p) in carried:
                    k, more = carried[int(p)]
                    at = (part == p) & (conv == k)
                    for run, m in zip(runs, more, strict=True):
                        run[at] += np.int64(m)
            for s, run in zip(sums, runs, strict=True):
                made |= {f"{s}_run": run, f"{s}_old": run - np.asarray(batch.column(s))}
            yield pa.RecordBatch.from_pydict(made)

    return made.mapInArrow(add, _ddl(rows) + "".join(f", {s}_run long, {s}_old long" for s in sums))


def made_before(carried: tuple | None, conv: int, n: int) -> list[int]:
    """Sums that a conversation brings from earlier partitions."""
    return carried[1] if carried is not None and carried[0] == conv else [0] * n


def sequences(rows: DataFrame, borrow: bool, parts: int, scope: Scope) -> DataFrame:
    """conv, depth, s1, s2 (name of the prefix), p1, p2 (name of the prefix before), chars of its last turn, ends (whether the
    conversation ends there), for every prefix of every conversation, the empty one included."""
    turns = scope.table(narrow_turns(rows))
    convs = turns.groupBy("conv").agg(F.count("*").alias("own"))
    if borrow:
        first = Window.partitionBy("conv").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "code")])
        begun = turns.where("conv % 100 = 0").withColumn("at", F.row_number().over(first)).where(F.col("at") <= HEAD_TURNS)
        begun = begun.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "k1", "k2", "chars"))).alias("head"))
        convs = convs.withColumns({"skip": borrowed_turns(F.col("conv")), "from": F.col("conv") - F.col("conv") % 100})
        convs = convs.join(begun.select(F.col("conv").alias("from"), "head"), "from", "left").drop("from")
        convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast(begun.schema["head"].dataType)), F.lit(1), F.col("skip")))
    else:
        convs = convs.withColumns({"skip": F.lit(0), "head": F.expr("cast(array() as array<struct<at: int, k1: long, k2: long, chars: long>>)")})
    convs = scope.table(convs.withColumns({"skip": F.col("skip").cast("long"), "begun": F.size("head").cast("long")}))
    zero = F.lit(0).cast("long")
    # kind 0 opens a conversation, its sums tell all later rows what it skips and borrows; kind 1: its own turns
    opening = convs.select("conv", F.lit(0).alias("kind"), zero.alias("turn"), F.lit("").alias("role"), F.lit("").alias("code"),
                           zero.alias("k1"), zero.alias("k2"), zero.alias("chars"), "skip", "begun", zero.alias("one"))
    own = turns.select("conv", F.lit(1).alias("kind"), "turn", "role", "code", "k1", "k2", "chars", zero.alias("skip"), zero.alias("begun"),
                       F.lit(1).cast("long").alias("one"))
    placed = running_sums(opening.unionByName(own), ["kind", "turn", "role", "code"], ["skip", "begun", "one"], parts, scope)
    left = placed.where("kind = 1 and one_run > skip_run")
    kept = left.select("conv", (F.col("begun_run") + F.col("one_run") - F.col("skip_run")).alias("depth"), "k1", "k2", "chars", zero.alias("length"))
    head = convs.select("conv", F.explode("head").alias("h")).select("conv", F.col("h.at").cast("long").alias("depth"), "h.k1", "h.k2", "h.chars",
                                                                     zero.alias("length"))
    length = F.col("begun") + F.greatest(zero, F.col("own") - F.col("skip"))
    root = convs.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("chars"), length.alias("length"))
    every = kept.unionByName(head).unionByName(root).withColumns(
        {f"m{i}": F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "depth", "k1", "k2")).otherwise(zero) for i in (1, 2)})
    sums = running_sums(every, ["depth"], ["m1", "m2", "length"], parts, scope)
    return sums.select("conv", "depth", "chars", F.col("m1_run").alias("s1"), F.col("m2_run").alias("s2"), F.col("m1_old").alias("p1"),
                       F.col("m2_old").alias("p2"), (F.col("depth") == F.col("length_run")).alias("ends"))


def next_siblings(tops: DataFrame, parts: int, scope: Scope) -> DataFrame:
    """conv, next: the path that hangs on the same node behind this one, for paths (conv, up, at) that hang on node (up, at)."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rest = TaskContext.get().partitionId(), None  # the last row waits for the next batch
        first = True
        for batch, last in _held_back(batches):
            up, at, conv = (np.asarray(batch.column(i)) for i in range(3))
            if rest is not None:
                up, at, conv = (np.concatenate([[r], c]) for r, c in zip(rest, (up, at, conv), strict=True))
            n = len(conv) if last else len(conv) - 1
            same = np.append((up[1:] == up[:-1]) & (at[1:] == at[:-1]), False)
            yield pa.RecordBatch.from_pydict({
                "conv": conv[:n], "next": pa.array(np.append(conv[1:], 0)[:n], mask=~same[:n]), "up": up[:n], "at": at[:n],
                "part": np.full(n, part, np.int32), "edge": ((np.arange(n) == 0) & first) + 2 * ((np.arange(n) == n - 1) & last).astype(np.int32)})
            rest, first = (up[-1], at[-1], conv[-1]), first and n == 0

    order = ["up", "at", "conv"]
    made = scope.table(tops.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        local, "conv long, next long, up long, at long, part int, edge int"))
    edges = sorted(made.where("edge > 0").select("part", "edge", "up", "at", "conv").collect())  # at most two rows per partition
    heads = [e for e in edges if e.edge & 1]
    after = {x.part: y for x, y in zip(heads, heads[1:], strict=False)}
    found = [(e.conv, after[e.part].conv) for e in edges if e.edge & 2 and e.part in after and (e.up, e.at) == (after[e.part].up, after[e.part].at)]
    border = made.sparkSession.createDataFrame(found, "conv long, over long")
    return made.join(F.broadcast(border), "conv", "left").select("conv", F.coalesce("next", "over").alias("next"))


def tree_nodes(prefixes: DataFrame, parts: int, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """The nodes with what their arcs need, and (conv, depth, member) of every conversation's last node.

    Nodes: conv (smallest member), depth, s1, s2, n_convs, chars; up (the parent's conv); n_kids and first (paths that hang on
    it, besides the one it lies on), next (its next sibling, if it is the top of its path), after (the first path that hangs on
    its parent, if it is not), top, bottom."""
    nodes = scope.table(prefixes.groupBy("depth", "s1", "s2").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2")))
    ended = prefixes.where("ends").select(F.col("conv").alias("member"), "depth", "s1", "s2").join(
        nodes.select("conv", "depth", "s1", "s2"), ["depth", "s1", "s2"]).select("conv", "depth", "member")
    paths = nodes.groupBy("conv").agg(F.min(F.struct("depth", "p1", "p2")).alias("t"), F.max("depth").alias("bottom"))
    paths = scope.table(paths.select("conv", F.col("t.depth").alias("depth"), F.col("t.p1").alias("s1"), F.col("t.p2").alias("s2"), "bottom"))
    parents = nodes.select(F.col("conv").alias("up"), (F.col("depth") + 1).alias("depth"), "s1", "s2")
    hung = scope.table(paths.where("depth > 0").join(parents, ["depth", "s1", "s2"]).select("conv", "depth", "up"))
    following = next_siblings(hung.select("up", (F.col("depth") - 1).alias("at"), "conv"), parts, scope)
    kids = hung.groupBy("up", (F.col("depth") - 1).alias("at")).agg(F.min("conv").alias("first"), F.count("*").alias("n_kids"))
    none = F.lit(None).cast("long")
    notes = lambda conv, depth, **known: [conv.alias("conv"), depth.alias("depth"), *[known.get(n, none).alias(n) for n in (
        "up", "top", "bottom", "next", "first", "n_kids", "after")]]
    yes, depth = F.lit(1).cast("long"), F.col("depth")
    said = (paths.where("depth = 0").select(*notes(F.col("conv"), depth, top=yes))
            .unionByName(hung.join(following, "conv").select(*notes(F.col("conv"), depth, up=F.col("up"), top=yes, next=F.col("next"))))
            .unionByName(paths.select(*notes(F.col("conv"), F.col("bottom"), bottom=yes)))
            .unionByName(kids.select(*notes(F.col("up"), F.col("at"), first=F.col("first"), n_kids=F.col("n_kids"))))
            .unionByName(kids.select(*notes(F.col("up"), F.col("at") + 1, after=F.col("first")))))
    said = said.groupBy("conv", "depth").agg(*[F.max(c).alias(c) for c in ("up", "top", "bottom", "next", "first", "n_kids", "after")])
    known = nodes.drop("p1", "p2").join(said, ["conv", "depth"], "left")
    up = F.when(F.col("top") == 1, F.col("up")).when(depth > 0, F.col("conv"))
    return scope.table(known.withColumn("up", up).withColumn("n_kids", F.coalesce("n_kids", F.lit(0)))), scope.table(ended)


def with_arcs(nodes: DataFrame) -> DataFrame:
    """Each node's arcs: the arc after its enter arc (ec, ek) and after its exit arc (xc, xk; null behind the root's), and their weights.

    Arc (c, 2d) enters the node of conversation c at depth d, arc (c, 2d + 1) leaves it."""
    depth, conv = F.col("depth"), F.col("conv")
    own, leaf = F.col("bottom").isNull(), F.col("bottom").isNotNull() & F.col("first").isNull()
    sideways = F.when(F.col("top") == 1, F.col("next")).otherwise(F.col("after"))
    return nodes.select(
        "conv", "depth", "n_convs", F.col("up").alias("parent"), (F.col("n_kids") + own.cast("long")).alias("n_children"),
        F.when(own, conv).otherwise(F.coalesce("first", conv)).alias("ec"), F.when(leaf, 2 * depth + 1).otherwise(2 * depth + 2).alias("ek"),
        F.coalesce(sideways, F.col("up")).alias("xc"), F.when(sideways.isNotNull(), 2 * depth).otherwise(2 * depth - 1).alias("xk"),
        leaf.cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))


def contract(ids: np.ndarray, after: np.ndarray, known: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of successors among some list elements: for each element the index of its run's first element and the weights
    before it in the run; and the indices of the runs' last elements.

    ``ids``, ``after``: (n, 2) names of the elements and of their successors (used where ``known``); ``weights``: (n, w)."""
    n = len(ids)
    _, conv = np.unique(np.concatenate([ids[:, 0], after[:, 0]]), return_inverse=True)
    _, code = np.unique(np.concatenate([ids[:, 1], after[:, 1]]), return_inverse=True)
    name = conv.astype(np.int64) * (int(code.max(initial=0)) + 1) + code
    order = np.argsort(name[:n], kind="stable")
    place = np.minimum(np.searchsorted(name[:n][order], name[n:]), max(n - 1, 0))
    met = known & (name[:n][order][place] == name[n:])
    jump, before = np.arange(n), np.zeros_like(weights)
    jump[order[place[met]]] = np.flatnonzero(met)
    inner = jump != np.arange(n)
    before[inner] = weights[jump[inner]]
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump, before, np.flatnonzero(~met)
        before = before + before[jump]
        jump = further


_PAIR = ("c", "k")
_W = ("arcs", "leaves", "saved")
ELEMENTS = "c long, k long, c_ long, k_ long, arcs long, leaves long, saved long"   # an element, its successor, its weights
MOVED = "hc long, hk long, arcs_ long, leaves_ long, saved_ long"                    # a run's first element, weights before in the run


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of about ``size`` rows."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= size:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table, names) -> np.ndarray:
    return np.stack([np.asarray(table.column(n).fill_null(0)).astype(np.int64) for n in names], axis=1)


def _runs(ids, after, known, weights, jump, before, last) -> dict:
    """Elements that stand for whole runs."""
    head = jump[last]
    total = before[last] + weights[last]
    return {"c": ids[head, 0], "k": ids[head, 1], "c_": pa.array(after[last, 0], mask=~known[last]), "k_": pa.array(after[last, 1], mask=~known[last]),
            **{w: total[:, i] for i, w in enumerate(_W)}}


def _split(made: DataFrame, elements: str) -> tuple[DataFrame, DataFrame]:
    names = [x.split()[0] for x in elements.split(", ")]
    return made.where("run").select(*names), made.where("not run").drop("run")


def contract_paths(arcs: DataFrame, parts: int, scope: Scope, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """Elements of contracted runs, and the nodes with the run's first element and the weights before in it for both arcs.

    Nodes go to range partitions in order of (conv, depth): a path lies together, and siblings mostly do."""
    kept = ["conv", "depth", "n_convs", "parent", "n_children"]
    ends = [f"{x}_{y}" for x in ("enter", "exit") for y in ("c", "k", *_W)]
    schema = ", ".join([f"{x} long" for x in kept + ends]) + f", {ELEMENTS}, run boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches, share):
            n = table.num_rows
            conv, depth = (np.asarray(table.column(x)) for x in ("conv", "depth"))
            ids = np.concatenate([np.stack([conv, 2 * depth + e], axis=1) for e in (0, 1)])
            after = np.concatenate([_columns(table, ("ec", "ek")), _columns(table, ("xc", "xk"))])
            known = np.concatenate([np.ones(n, bool), np.asarray(table.column("xc").is_valid())])
            weights = np.zeros((2 * n, 3), np.int64)
            weights[:, 0] = 1
            weights[:n, 1:] = _columns(table, ("leaf", "saved"))
            jump, before, last = contract(ids, after, known, weights)
            first = ids[jump]
            made = {**{x: table.column(x).combine_chunks() for x in kept}, "run": np.zeros(n, bool)}
            for e, x in enumerate(("enter", "exit")):
                at = slice(e * n, (e + 1) * n)
                made |= {f"{x}_c": first[at, 0], f"{x}_k": first[at, 1], **{f"{x}_{w}": before[at, i] for i, w in enumerate(_W)}}
            for size, found in ((n, made), (len(last), {**_runs(ids, after, known, weights, jump, before, last), "run": np.ones(len(last), bool)})):
                yield pa.RecordBatch.from_arrays([pa.array(found[x]) if x in found else pa.nulls(size, pa.int64()) for x in names], names=names)

    order = ["conv", "depth"]
    made = scope.table(arcs.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema))
    elements, nodes = _split(made, ELEMENTS)
    return elements, nodes.select(*kept, *ends)


def list_rank(elements: DataFrame, parts: int, scope: Scope, base: int = BASE, share: int = SHARE) -> DataFrame:
    """c, k, arcs_, leaves_, saved_: the weights of all elements before each element of the list."""
    schema = f"{ELEMENTS}, {MOVED}, run boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches, share):
            ids, after, weights = (_columns(table, x) for x in (_PAIR, ("c_", "k_"), _W))
            known = np.asarray(table.column("c_").is_valid())
            jump, before, last = contract(ids, after, known, weights)
            gone = np.flatnonzero(jump != np.arange(len(ids)))
            moved = {"c": ids[gone, 0], "k": ids[gone, 1], "hc": ids[jump[gone], 0], "hk": ids[jump[gone], 1],
                     **{f"{w}_": before[gone, i] for i, w in enumerate(_W)}, "run": np.zeros(len(gone), bool)}
            for size, found in ((len(gone), moved), (len(last), {**_runs(ids, after, known, weights, jump, before, last), "run": np.ones(len(last), bool)})):
                yield pa.RecordBatch.from_arrays([pa.array(found[x]) if x in found else pa.nulls(size, pa.int64()) for x in names], names=names)

    rounds, now = [], elements
    while (n := now.count()) > base:
        toss = F.pmod(F.xxhash64(F.lit(len(rounds)), "c", "k"), F.lit(2)) == 1
        dealt = now.withColumns({"to_c": F.when(toss, F.col("c")).otherwise(F.coalesce("c_", "c")),
                                 "to_k": F.when(toss, F.col("k")).otherwise(F.coalesce("k_", "k"))})
        tasks = max(parts, -(-n // share))
        made = scope.table(dealt.repartition(tasks, "to_c", "to_k").sortWithinPartitions("to_c", "to_k").drop("to_c", "to_k").mapInArrow(run, schema))
        now, moved = _split(made, ELEMENTS)
        rounds.append(moved.select(*_PAIR, *[x.split()[0] for x in MOVED.split(", ")]))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches, base + 1):  # all that is left: at most ``base`` elements
            ids, after, weights = (_columns(table, x) for x in (_PAIR, ("c_", "k_"), _W))
            _, before, _ = contract(ids, after, np.asarray(table.column("c_").is_valid()), weights)
            yield pa.RecordBatch.from_pydict({"c": ids[:, 0], "k": ids[:, 1], **{f"{w}_": before[:, i] for i, w in enumerate(_W)}})

    placed = scope.table(now.coalesce(1).mapInArrow(rank, "c long, k long, arcs_ long, leaves_ long, saved_ long"))
    for moved in reversed(rounds):
        heads = placed.select(F.col("c").alias("hc"), F.col("k").alias("hk"), *[F.col(f"{w}_").alias(f"{w}_of") for w in _W])
        back = moved.join(heads, ["hc", "hk"]).select(*_PAIR, *[(F.col(f"{w}_") + F.col(f"{w}_of")).alias(f"{w}_") for w in _W])
        placed = scope.table(placed.unionByName(back))
    return placed


def member_digests(ended: DataFrame, parts: int) -> DataFrame:
    """conv, depth, ends_sha256: SHA-256 of the decimal members that end at a node, ascending, joined by commas.

    Ids become text in range partitions of (node, member); one task then streams a node's chunks of text in order."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, member = (np.asarray(batch.column(i)) for i in range(3))
            cut = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1]))) if len(conv) else np.zeros(0, int)
            ends = np.append(cut[1:], len(conv))
            names = batch.column(2).cast(pa.string()).to_pylist()
            yield pa.RecordBatch.from_pydict({"conv": conv[cut], "depth": depth[cut], "member": member[cut],
                                              "ids": [",".join(names[a:b]) for a, b in zip(cut, ends, strict=True)]})

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def out(rows: list) -> pa.RecordBatch:
            conv, depth, sha = zip(*rows, strict=True)
            return pa.RecordBatch.from_pydict({"conv": pa.array(conv, pa.int64()), "depth": pa.array(depth, pa.int64()), "ends_sha256": list(sha)})

        for batch in batches:
            done = []
            for conv, depth, ids in zip(*(batch.column(x).to_pylist() for x in ("conv", "depth", "ids")), strict=True):
                if (conv, depth) == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (conv, depth), hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield out(done)
        if node is not None:
            yield out([(*node, digest.hexdigest())])

    order = ["conv", "depth", "member"]
    text = ended.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        chunks, "conv long, depth long, member long, ids string")
    return text.repartition(parts, "conv", "depth").sortWithinPartitions(*order).mapInArrow(stream, "conv long, depth long, ends_sha256 string")


def prefix_trie(rows: DataFrame, borrow: bool = False, base: int = BASE, share: int = SHARE) -> DataFrame:
    """One row per node of the trie of the conversations in ``rows`` (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and enter and
    exit: the places of the node's arcs in the tour.  ``borrow``: a conversation begins with the first :func:`borrowed_turns` turns
    of the first conversation of its hundred, in place of as many of its own.  ``base``, ``share``: see the module."""
    spark = rows.sparkSession
    parts = partitions(spark)
    with Scope(spark) as scope:
        prefixes = scope.table(sequences(rows, borrow, parts, scope))
        nodes, ended = tree_nodes(prefixes, parts, scope)
        elements, placed = contract_paths(with_arcs(nodes), parts, scope, share)
        sums = list_rank(elements, parts, scope, base, share)
        for x in ("enter", "exit"):
            of = sums.select(F.col("c").alias(f"{x}_c"), F.col("k").alias(f"{x}_k"), *[F.col(f"{w}_").alias(f"{x}_{w}_of") for w in _W])
            placed = placed.join(of, [f"{x}_c", f"{x}_k"])
        inside = lambda w: (F.col(f"exit_{w}") + F.col(f"exit_{w}_of") - F.col(f"enter_{w}") - F.col(f"enter_{w}_of"))
        digests = member_digests(ended, parts)
        return cut_lineage(placed.join(digests, ["conv", "depth"], "left").select(
            F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
            inside("leaves").alias("n_leaves"), inside("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
            (F.col("enter_arcs") + F.col("enter_arcs_of")).alias("enter"), (F.col("exit_arcs") + F.col("exit_arcs_of")).alias("exit")))
