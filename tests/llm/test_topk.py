"""MaxScore against all inner products."""
import math
import random

from storewatch.llm import topk
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def brute(rows, k, scale=256):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, vec in sorted({(i, tuple(v)) for i, v in ok if i % 50 == 0}):
        best = sorted((-sum(a * b for a, b in zip(vec, v)), i) for i, v in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)]) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(30)]                      # ties
    rows += [(600, [0.0] * 12), (601, []), (602, [1.0, -2.0]), (603, [0.001] * 12)]
    rows += [(700, None), (701, [NAN] * 12), (702, [None] * 12), (703, [INF] * 12), (None, [1.0] * 12)]
    rows += [rows[20], rows[20], rows[100]]                                   # repeated rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    vecs = df.select("vec_id", topk.quantised(F.col("embedding"), 256).alias("vec"), "score")
    got = topk.top_k(vecs.filter("vec_id % 50 = 0"), vecs, 5, id_col="vec_id", shard_rows=64, block_rows=3).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5)


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1]), (1, [2])], "id long, vec array<long>")
    assert [tuple(r) for r in topk.top_k(df.filter("id = 0"), df, 5).collect()] == [(0, 1, 1, 2)]
    assert topk.top_k(df.limit(0), df, 5).count() == 0
    assert topk.top_k(df.filter("id = 0"), df.limit(0), 5).count() == 0
