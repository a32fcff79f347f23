"""Exact top-k inner product search by MaxScore over sharded postings.

Dimensions are the terms, integer components the weights, rows the documents.  Rows are dealt to shards
of a bounded size; a task holds one shard and one block of queries.  In a shard every term has a postings
list (rows with a non-zero weight) and bounds of its weights; a query term's bound is the most it can add
to any row's score.  A query takes its terms in descending order of bound.  The terms whose bounds
together stay below the k-th best score so far are non-essential: no row can enter the result by them
alone.  Essential postings are traversed and summed; the other terms are probed only for rows whose sum
plus the bounds still to come reaches the k-th best score (equal counts: ties are kept).  The shards'
k best rows per query are then merged.

Scale: queries x rows is the stated work; each (shard, query block) pair is one task of fixed size, so
more rows give more tasks, never larger ones.  Nothing is broadcast or collected but two row counts.

Defined cases: null vectors and vectors with a null or non-finite component take no part, neither as
query nor as candidate; shorter vectors lack the later terms; zero vectors and empty arrays score 0;
equal scores go to the smaller id; a repeated row is a candidate each time, a repeated query counts once;
rows that share the query's id are the query's own; rows with a null id take no part.  Components must
satisfy ``|scale * x| < 2^28`` for the sums to fit 64 bits.  Other columns are not read.
"""
from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROBE = 8  # non-essential terms probed between two prunings


def quantised(vec: Column, scale: int) -> Column:
    """floor(scale * x) of every component as long, x as double; null if the vector takes no part."""
    usable = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(usable, F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list<long> column, short ones padded with 0."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = np.diff(np.asarray(arr.offsets))
    flat = np.asarray(arr.flatten(), dtype=np.int64)
    out = np.zeros((len(arr), max(1, int(sizes.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(arr)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Shard:
    """Postings of some rows: per term the row numbers and weights, and the weights' bounds."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.high, self.low = self.rows.max(axis=0), self.rows.min(axis=0)
        self.postings = []
        for t in range(rows.shape[1]):
            at = np.flatnonzero(self.rows[:, t])
            self.postings.append((at, self.rows[at, t]))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than the query's own, best first, ties by id."""
        terms = min(len(query), self.rows.shape[1])
        weight = query[:terms]
        bound = np.maximum(0, np.maximum(weight * self.high[:terms], weight * self.low[:terms]))
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # bounds of the terms still to come
        total = np.zeros(len(self.ids), np.int64)
        live = self.ids != query_id
        if not live.any():
            return self.ids[:0], total[:0]
        floor, seen = None, 0
        while seen < terms and (floor is None or rest[seen] >= floor):  # essential
            at, value = self.postings[order[seen]]
            if weight[order[seen]]:
                total[at] += weight[order[seen]] * value
            seen += 1
            if seen % PROBE == 0:
                floor = self._floor(total, live, weight, k, floor)
        rows = np.flatnonzero(live if floor is None else live & (total + rest[seen] >= floor))
        score = total[rows]
        while seen < terms and len(rows):  # probe the others while competitive
            some = order[seen:seen + PROBE]
            score = score + self.rows[np.ix_(rows, some)] @ weight[some]
            seen += len(some)
            if floor is not None:
                fit = score + rest[seen] >= floor
                rows, score = rows[fit], score[fit]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]

    def _floor(self, total: np.ndarray, live: np.ndarray, weight: np.ndarray, k: int, floor: int | None) -> int | None:
        """k-th best exact score among the rows that lead so far: a lower bound of the final one."""
        rows = np.flatnonzero(live)
        if len(rows) < k:
            return None
        lead = rows[np.argpartition(-total[rows], k - 1)[:k]]
        exact = int((self.rows[lead][:, :len(weight)] @ weight).min())
        return exact if floor is None else max(floor, exact)


def top_k(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec",
          shard_rows: int = 16_384, block_rows: int = 2_048) -> DataFrame:
    """query_id, rank (from 1), ``id_col``, score: the k best rows of each query by integer inner product.

    Both frames hold ``id_col`` and ``vec_col`` (array of long, null: takes no part)."""
    valid = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()
    queries = queries.filter(valid).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).distinct()
    rows = rows.filter(valid).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    deal = lambda n: F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")
    left = rows.select("id", "vec", deal(shards).alias("shard"),
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                           deal(blocks).alias("block"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            shard = Shard(np.asarray(a["id"]), _matrix(a["vec"]))
            for query_id, query in zip(np.asarray(b["id"]).tolist(), _matrix(b["vec"]), strict=True):
                ids, scores = shard.top(query_id, query, k)
                out += zip([query_id] * len(ids), ids.tolist(), scores.tolist(), strict=True)
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "id", "score"), cols, strict=True)})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        search, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
