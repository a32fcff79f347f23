"""Embedding near-duplicates by collision counting on one-dimensional projections.

Vectors are scaled to length 1 and projected on ``projections`` seeded Gaussian directions.  For a pair at
distance d the difference of a projection is normal with deviation d, so with a window of half-width
``width`` x d(threshold) around the query, a pair at the threshold collides in a projection with a known
probability p, independently of the others.  The count a pair must reach is the largest one that a pair at
the threshold reaches with probability ``recall`` (binomial tail; nearer pairs more often).  In a task every
projection of one side is sorted; a query's window is an interval of ranks found by binary search, and
the collisions of a pair are the projections in which its rank falls into the query's interval.  Pairs that
reach the count are verified by their cosine in double precision: nothing below the threshold is linked.

Equal vectors are one class with a multiplicity, so copies are never paired.  Classes are ordered by the
first projection and cut into strips of equal size, strips with many classes at one place into parts by a hash; only
strips that its window (with the same calibration) can bridge meet.  A task takes two strips and returns link counts per class and a spanning forest of its
links, never the links themselves.

Scale: the work is the pairs that one projection's window cannot rule out.  Windows on single projections
are wide in high dimensions, so the number of strip pairs still grows nearly with the square of the number
of classes (each a task of fixed size and memory); the README gives figures.  The driver holds the strip bounds (a few
numbers per ``strip_rows`` classes); pairs of strips are made on the executors.

Defined cases: null vectors, vectors with null or non-finite components and zero vectors link with nothing and
are their own component; vectors of different length never link; rows that repeat an id share a
component; a null id takes no part in links and is returned with n_links 0, component null, kept false; an
empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import bisect
import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.llm.graph import components, merge
from storewatch.session import Scope, cut_lineage

QUERIES = 256  # rows of one side counted together


def distance(threshold: float) -> float:
    """Distance of unit vectors whose cosine is ``threshold``."""
    return math.sqrt(2 - 2 * threshold)


def required_count(projections: int, width: float, recall: float) -> int:
    """Collisions that a pair at the threshold reaches with probability ``recall``."""
    p = 2 * NormalDist().cdf(width) - 1
    tail = 0.0
    for count in range(projections, 0, -1):
        tail += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if tail >= recall:
            return count
    return 0


def directions(size: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, projections))


def _rows(col: pa.ChunkedArray) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(arr.flatten(), dtype=np.float64).reshape(len(arr), -1)


def colliding(queries: np.ndarray, ranked: list[tuple[np.ndarray, np.ndarray]], half: float) -> np.ndarray:
    """Collisions of every (query, row) pair. ``ranked``: per projection its sorted values and each row's rank."""
    count = np.zeros((len(queries), len(ranked[0][0])), np.uint8)
    for i, (values, rank) in enumerate(ranked):
        lo = np.searchsorted(values, queries[:, i] - half, side="left").astype(np.uint16)
        hi = np.searchsorted(values, queries[:, i] + half, side="right").astype(np.uint16)
        count += (rank[None, :] - lo[:, None]) < (hi - lo)[:, None]  # unsigned: ranks below lo wrap around
    return count


def link_strips(left: pa.Table, right: pa.Table, same: bool, threshold: float, projections: int, width: float,
                recall: float, seed: int) -> pa.Table:
    """Links between two strips: kind 0 rows (node, key, vectors linked) and kind 1 rows (node, smaller node)."""
    x, y = _rows(left["vec"]), _rows(right["vec"])
    if len(y) > 65_535:
        raise ValueError("a strip has more rows than 16-bit ranks")
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    line = directions(x.shape[1], projections, seed)
    px, py = (x / nx[:, None]) @ line, (y / ny[:, None]) @ line
    half, need = width * distance(threshold), required_count(projections, width, recall)
    ranked = []
    for i in range(projections):
        order = np.argsort(py[:, i], kind="stable")
        rank = np.empty(len(order), np.uint16)
        rank[order] = np.arange(len(order))
        ranked.append((py[order, i], rank))
    many_x, many_y = np.asarray(left["many"]), np.asarray(right["many"])
    links_x, links_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    nodes = np.unique(np.concatenate([np.asarray(left["node"]), np.asarray(right["node"])]))
    at_x, at_y = np.searchsorted(nodes, np.asarray(left["node"])), np.searchsorted(nodes, np.asarray(right["node"]))
    root = np.arange(len(nodes))
    for lo in range(0, len(x), QUERIES):
        part = slice(lo, min(lo + QUERIES, len(x)))
        enough = colliding(px[part], ranked, half) >= need
        if same:
            enough &= np.arange(len(y))[None, :] > np.arange(lo, part.stop)[:, None]
        if enough.mean() > 0.02:  # one product rules most out; what is near the threshold is left to the same test as always
            enough &= (x[part] @ y.T) / (nx[part, None] * ny[None, :]) >= threshold - 1e-9
        q, c = np.nonzero(enough)
        near = np.einsum("ij,ij->i", x[lo + q], y[c]) / (nx[lo + q] * ny[c]) >= threshold
        q, c = q[near], c[near]
        q = q + lo
        np.add.at(links_x, q, many_y[c])
        np.add.at(links_y, c, many_x[q])
        merge(root, at_x[q], at_y[c])
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    a = [nodes[moved]]
    b = [nodes[root[moved]]]
    n = [np.zeros(len(moved), np.int64)]
    for table, links in ((left, links_x), (right, links_y)):
        some = np.flatnonzero(links)
        a.append(np.asarray(table["node"])[some])
        b.append(np.asarray(table["key"])[some])
        n.append(links[some])
    kind = np.concatenate([np.ones(len(moved), np.int32), np.zeros(sum(map(len, a[1:])), np.int32)])
    return pa.table({"kind": pa.array(kind), "a": pa.array(np.concatenate(a), pa.int64()),
                     "b": pa.array(np.concatenate(b), pa.int64()), "n": pa.array(np.concatenate(n), pa.int64())})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9,
                 projections: int = 24, width: float = 2.5, recall: float = 0.9999, seed: int = 11,
                 strip_rows: int = 8_192) -> DataFrame:
    """id, n_links (other vectors with a cosine of at least ``threshold``), component_id, kept of every row."""
    if strip_rows > 32_768 or not 0 < projections < 256:
        raise ValueError("ranks are 16-bit and counts 8-bit numbers")
    vec = F.col("vec")
    usable = (F.col("id").isNotNull() & vec.isNotNull()
              & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
              & F.exists(vec, lambda x: x != 0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    digest = [F.when(F.col("usable"), d).alias(n) for n, d in (("key", F.xxhash64("vec")), ("key2", F.xxhash64(F.lit(seed), "vec")))]
    half = NormalDist().inv_cdf((1 + recall) / 2) * distance(threshold)
    with Scope(vectors.sparkSession) as scope:
        classes = (rows.filter("usable").select("id", "vec", *digest).groupBy("key", "key2")
                   .agg(F.min("id").alias("node"), F.count("*").alias("many"), F.first("vec").alias("vec"))
                   .withColumn("size", F.size("vec")))

        def first(batches):
            for batch in batches:
                flat = batch.column(batch.schema.get_field_index("vec"))
                place = np.empty(batch.num_rows)
                sizes = np.diff(np.asarray(flat.offsets))
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    x = _rows(flat.take(pa.array(at)))
                    place[at] = (x / np.linalg.norm(x, axis=1)[:, None]) @ directions(int(size), projections, seed)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

        placed = scope.table(classes.mapInArrow(first, "key long, key2 long, node long, many long, vec array<double>, "
                                                       "size int, place double"))
        strips = _strips(placed, strip_rows, half)
        dealt = placed.join(strips, (placed["size"] == strips["size"]) & (placed["place"] >= F.col("lo"))
                            & (placed["place"] < F.col("hi"))).select(placed["*"], "strip")
        held = scope.table(dealt.groupBy("size", "strip").agg(F.ceil(F.count("*") / strip_rows).cast("int").alias("parts")))
        part = F.pmod(F.xxhash64(F.lit(seed), "key", "key2"), F.col("parts")).cast("int")
        dealt = scope.table(dealt.join(held, ["size", "strip"]).withColumn("part", part).drop("key2", "place", "parts"))
        wanted = scope.table(_strip_pairs(strips, held))
        cols = ["node", "key", "many", "vec"]
        pair = ["size", "strip", "part", "other", "other_part"]
        left = dealt.join(wanted, ["size", "strip", "part"]).select(*pair, *cols)
        right = dealt.withColumnsRenamed({"strip": "other", "part": "other_part"}).join(wanted, ["size", "other", "other_part"]).select(
            *[F.col(c).alias(c) for c in (*pair, *cols)])  # columns of its own: both sides are dealt

        def search(key, a: pa.Table, b: pa.Table) -> pa.Table:
            same = key[1].as_py() == key[3].as_py() and key[2].as_py() == key[4].as_py()
            return link_strips(a, b, same, threshold, projections, width, recall, seed)

        found = scope.table(left.groupBy(*pair).cogroup(right.groupBy(*pair))
                            .applyInArrow(search, "kind int, a long, b long, n long"))
        counts = found.filter("kind = 0").groupBy(F.col("a").alias("node"), F.col("b").alias("key")).agg(F.sum("n").alias("links"))
        moved = components(found.filter("kind = 1").select("a", "b"), scope)
        named = (placed.select("node", "key", "key2", "many").join(counts, ["node", "key"], "left").join(moved, "node", "left")
                 .select("key", "key2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"),
                         F.coalesce("component", "node").alias("component")))
        done = rows.select("id", *digest).join(named, ["key", "key2"], "left")
        component = F.coalesce("component", "id")
        return cut_lineage(done.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                                       component.alias("component_id"),
                                       F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")))


def _strips(placed: DataFrame, strip_rows: int, half: float) -> DataFrame:
    """size, strip, lo, hi, last (the last strip whose gap to this one the first projection's window bridges)."""
    out = []
    for r in placed.groupBy("size").agg(F.count("*").alias("n")).collect():  # one row per vector length
        strips = -(-r.n // strip_rows)
        inner = placed.filter(F.col("size") == r.size).approxQuantile(
            "place", [i / strips for i in range(1, strips)], 0.1 / strips) if strips > 1 else []
        edges = [-math.inf, *sorted(set(inner)), math.inf]
        lows = edges[:-1]
        out += [(r.size, i, lo, hi, min(len(lows) - 1, max(i + 1, bisect.bisect_right(lows, hi + half) - 1)))
                for i, (lo, hi) in enumerate(zip(lows, edges[1:], strict=True))]
    return placed.sparkSession.createDataFrame(out, "size int, strip int, lo double, hi double, last int")


def _strip_pairs(strips: DataFrame, held: DataFrame) -> DataFrame:
    """size, strip, part, other, other_part: the pieces that meet, each pair once.

    A strip that holds more than its share (many classes at one place) has several parts; ``held``: parts of each strip."""
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = strips.select("size", "strip", F.explode(F.sequence("strip", "last")).alias("other")).join(held, ["size", "strip"])
    met = met.join(held.select("size", F.col("strip").alias("other"), F.col("parts").alias("others")), ["size", "other"])
    met = met.select("size", "strip", "other", "others", parts("parts").alias("part")).select(
        "size", "strip", "part", "other", parts("others").alias("other_part"))
    return met.filter((F.col("other") > F.col("strip")) | (F.col("other_part") >= F.col("part")))
