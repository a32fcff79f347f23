"""Source / sink queries: CSV encodings, partitioned risk output, history appends."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.constants import BIN2RANK, KEY_MCT, KEY_YM
from storewatch.plans.catalog import panel, r6, register, scored
from storewatch.plans.oracle_panel import panel_ctes
from storewatch.plans.oracle_risk import r6s, scored_ctes
from storewatch.plans.q_requests import QS_SQL, _qs
from storewatch.session import ensure_checkpoint_dir
from storewatch.operators.reports import top_k
from storewatch.sources.files import (append_history, load_risk_output, read_csv_smart, read_predictions, write_csv, write_predictions,
                                      write_risk_output, write_top)
from storewatch.sources.typed import SCHEMAS, score_csv


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


@register("read_csv_encoding", f"""WITH {panel_ctes()}
SELECT w.written, w.detected, (SELECT COUNT(*) FROM ds2) AS n, (SELECT COUNT(*) FROM ds2 WHERE RC_M1_SAA IN
  ({", ".join(f"'{k}'" for k in BIN2RANK)})) AS n_known_labels
FROM (VALUES ('utf-8', 'utf-8'), ('cp949', 'cp949'), ('euc-kr', 'cp949')) w(written, detected)""")
def q_read_csv_encoding(spark, sf):
    """The usage table (Korean bin labels) written as UTF-8, CP949 and EUC-KR CSV, read back with detection:
    detected encoding, rows, and rows whose label is a known bin (all of them when decoded right)."""
    base = _scratch(spark, "csv")
    usage = panel(spark, sf).usage
    known = F.col("RC_M1_SAA").isin(*BIN2RANK.keys())
    parts = []
    for enc in ("utf-8", "cp949", "euc-kr"):
        path = f"{base}/{enc}"
        write_csv(usage, path, enc)
        df, found = read_csv_smart(spark, path)
        parts.append(df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(known, 1)).alias("n_known_labels"))
                     .select(F.lit(enc).alias("written"), F.lit(found).alias("detected"), "n", "n_known_labels"))
    return reduce(DataFrame.unionByName, parts)


@register("risk_output_sink", f"""WITH {scored_ctes(True)}
SELECT ENCODED_MCT, TA_YM, ROUND(p_final, 6) AS p_final, Alert FROM alerted""")
def q_risk_output_sink(spark, sf):
    """Risk output written partitioned by month (a reader of some months scans only their folders), read back whole."""
    path = _scratch(spark, "risk_output")
    write_risk_output(scored(spark, sf), path)
    back = load_risk_output(spark, path)
    return back.select(KEY_MCT, KEY_YM, *r6("p_final"), "Alert")


@register("history_append", f"""WITH {panel_ctes()}, {QS_SQL}
SELECT store_id, target_month, {r6s('p_final')} AS p_final, alert, Sales_Risk, Customer_Risk, Market_Risk FROM rq""")
def q_history_append(spark, sf):
    """Prediction records appended in two batches (before / from 1998), then read back whole."""
    path = _scratch(spark, "history")
    q = _qs(spark, sf).select("store_id", "target_month", "Sales_Risk", "Customer_Risk", "Market_Risk", "p_final",
                              "alert")
    append_history(q.where(F.col("target_month") < "1998-01"), path)
    append_history(q.where(F.col("target_month") >= "1998-01"), path)
    back = spark.read.parquet(path)
    comps = F.from_json("risk_components", "Sales_Risk double, Customer_Risk double, Market_Risk double")
    return back.select("store_id", "target_month", *r6("p_final"), "alert", comps.alias("rc")).select(
        "store_id", "target_month", "p_final", "alert", "rc.*")


_BROKEN = ["usage", "customers", "merchants", "preds"]
_EVERY = {"usage": 7, "customers": 11, "merchants": 4, "preds": 13}    # one broken line of each kind per so many rows
_PICK = "CAST(ENCODED_MCT AS BIGINT) % {n} = 0"


def _broken_lines(df: DataFrame, n: int) -> DataFrame:
    """Lines that do not fit, derived from the rows of every n-th store: cut short, a field too many, no store."""
    some = df.where(_PICK.format(n=n))
    csv = F.to_csv(F.struct(*df.columns))
    rest = F.to_csv(F.struct(*df.columns[1:]))
    return some.select(F.explode(F.array(F.substring_index(csv, ",", 2), F.concat(csv, F.lit(",more")), F.concat(F.lit(","), rest))).alias("value"))


def _write_inputs(spark, sf, base: str) -> dict:
    """The four inputs as CSV folders, with broken lines among them (files of their own, with the header)."""
    p = panel(spark, sf)
    paths = {}
    for name, df in (("merchants", p.merchants), ("usage", p.usage), ("customers", p.customers), ("preds", p.preds)):
        known = [f.name for f in SCHEMAS[name].fields if f.name in df.columns]
        df = df.select(*known)
        paths[name] = f"{base}/{name}"
        write_csv(df, paths[name])
        broken = _broken_lines(df, _EVERY[name]).repartition(2)
        header = ",".join(known)
        broken.mapInArrow(_with_header(header), "value string").write.mode("append").text(paths[name])
    return paths


def _with_header(header: str):
    def run(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_pydict({"value": ([header] if first else []) + lines})
                first = False

    return run


@register("csv_to_csv", f"""WITH {scored_ctes(True)}
SELECT ENCODED_MCT, TA_YM, ROUND(RiskScore, 6) AS RiskScore, ROUND(p_final, 6) AS p_final, Alert FROM alerted""")
def q_csv_to_csv(spark, sf):
    """The whole pipeline from CSV files with broken lines among them to a CSV folder, read back."""
    base = _scratch(spark, "csv")
    out = score_csv(spark, _write_inputs(spark, sf, base), f"{base}/out", f"{base}/rejected")
    return out.select(KEY_MCT, KEY_YM, *r6("RiskScore", "p_final"), "Alert")


_COUNT = {"usage": "ds2", "customers": "ds3", "merchants": "ds1", "preds": "preds"}


@register("csv_rejected", f"""WITH {panel_ctes()}, n AS ({" UNION ALL ".join(
    f"SELECT '{k}' AS input, COUNT(*) AS k FROM {t} WHERE {_PICK.format(n=_EVERY[k])}" for k, t in _COUNT.items())})
SELECT input, r.reasons, k * r.times AS n FROM n, (VALUES ('malformed', 2), ('missing ENCODED_MCT', 1)) r(reasons, times)""")
def q_csv_rejected(spark, sf):
    """Lines that the typed readers set aside, by input and reason."""
    base = _scratch(spark, "csv")
    score_csv(spark, _write_inputs(spark, sf, base), f"{base}/out", f"{base}/rejected")
    rejected = spark.read.option("header", True).option("escape", chr(34)).csv(f"{base}/rejected")
    return rejected.groupBy("input", "reasons").agg(F.count(F.lit(1)).alias("n"))


def _files(spark, path: str) -> dict:
    """Name and time of every data file below a folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    out = {}
    while found.hasNext():
        f = found.next()
        if f.getPath().getName().endswith(".parquet"):
            out[f.getPath().toString()] = f.getModificationTime()
    return out


@register("predictions_sink", f"""WITH {panel_ctes()}, m AS (SELECT *, dense_rank() OVER (ORDER BY TA_YM) AS place FROM preds)
SELECT ENCODED_MCT, TA_YM, ROUND(CASE WHEN place = 5 THEN pred_xgb / 2 ELSE pred_xgb END, 6) AS pred_xgb, ROUND(pred_dl, 6) AS pred_dl, 1 AS others_untouched
FROM m""")
def q_predictions_sink(spark, sf):
    """Predictions written by month, then one month rerun with other scores: that month is replaced, the files of the others stay."""
    path = _scratch(spark, "predictions")
    preds = panel(spark, sf).preds.withColumn(KEY_YM, F.to_date(F.col(KEY_YM)))
    nowhere = preds.limit(5).withColumn(KEY_MCT, F.lit(None).cast("string"))
    write_predictions(preds.unionByName(nowhere), path)
    before = _files(spark, path)
    month = preds.select(KEY_YM).distinct().orderBy(KEY_YM).offset(4).first()[0]
    write_predictions(preds.where(F.col(KEY_YM) == F.lit(month)).withColumn("pred_xgb", F.col("pred_xgb") / 2), path)
    after = _files(spark, path)
    mine = f"month={month:%Y-%m}"
    same = {f: t for f, t in before.items() if mine not in f} == {f: t for f, t in after.items() if mine not in f}
    changed = not {f for f in before if mine in f} & {f for f in after if mine in f}
    return read_predictions(spark, path).select(KEY_MCT, KEY_YM, *r6("pred_xgb", "pred_dl"), F.lit(int(same and changed)).alias("others_untouched"))


@register("topk_sink", f"""WITH {scored_ctes(True)}
SELECT ENCODED_MCT, TA_YM, ROUND(p_final, 6) AS p_final, Alert, 1 AS n_files FROM (
  SELECT * FROM alerted ORDER BY p_final DESC, ENCODED_MCT, TA_YM LIMIT 20)""")
def q_topk_sink(spark, sf):
    """The 20 highest scores as one CSV file that replaces the one before, read back."""
    path = _scratch(spark, "top")
    s = scored(spark, sf)
    write_top(top_k(s, "p_final", 5), path)
    write_top(top_k(s, "p_final", 20), path)
    back = spark.read.option("header", True).schema(s.schema).csv(path)
    return back.select(KEY_MCT, KEY_YM, *r6("p_final"), "Alert", F.lit(len(back.inputFiles())).alias("n_files"))
