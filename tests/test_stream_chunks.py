"""A store's rows of one micro-batch are rated in order of time wherever Spark cuts them."""
import datetime as dt
import random

import pandas as pd

from storewatch.session import new_folder
from storewatch.streaming.streams import read_stream_like, run_available_now, stream_persistence_alerts

T0 = dt.datetime(2024, 1, 1)


def test_persistence_sorts_across_arrow_chunks(spark):
    rng = random.Random(3)
    rows = [(s, T0 + dt.timedelta(days=i), None if i % 11 == 5 else rng.random()) for s in "abc" for i in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "store_id string, ts timestamp, p_final double")
    folder, name = new_folder(spark, "streams"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        src = read_stream_like(spark, df, f"{folder}/in", "ts", slices=2, files=1)
        out = run_available_now(stream_persistence_alerts(src), folder, "p").collect()
    finally:
        spark.conf.set(name, old)
    want = {}
    for s, rows_of in pd.DataFrame(rows, columns=["s", "ts", "p"]).dropna().sort_values("ts").groupby("s"):
        want |= {(s, t): round(m, 6) for t, m in zip(rows_of.ts, rows_of.p.rolling(3, min_periods=1).mean())}
    assert {(r.store_id, r.ts): round(r.pbar, 6) for r in out} == want and len(out) == len(want)
