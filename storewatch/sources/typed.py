"""Typed CSV inputs of the batch pipeline: declared schemas, broken rows set aside with their reasons, scoring from files to files."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storewatch.constants import AGE_COLS, CLOSE_DATE, KEY_MCT, KEY_YM, TYPE_COLS
from storewatch.plans.pipeline import run_pipeline
from storewatch.session import cut_lineage
from storewatch.sources.files import detect_encoding, replace_folder

CORRUPT = "_corrupt_record"


def _fields(text: Sequence[str] = (), number: Sequence[str] = (), date: Sequence[str] = ()) -> T.StructType:
    return T.StructType([T.StructField(c, t) for cs, t in ((text, T.StringType()), (number, T.DoubleType()), (date, T.DateType())) for c in cs])


# fixed values: column names of the input files
MERCHANTS = _fields([KEY_MCT, "HPSN_MCT_ZCD_NM", "HPSN_MCT_BZN_CD_NM"], date=[CLOSE_DATE])
USAGE = _fields([KEY_MCT, KEY_YM, "RC_M1_SAA", "RC_M1_TO_UE_CT", "RC_M1_UE_CUS_CN", "RC_M1_AV_NP_AT", "APV_CE_RAT", "MCT_OPE_MS_CN"],
                ["DLV_SAA_RAT", "M1_SME_RY_SAA_RAT", "M1_SME_RY_CNT_RAT", "M12_SME_RY_SAA_PCE_RT", "M12_SME_BZN_SAA_PCE_RT",
                 "M12_SME_RY_ME_MCT_RAT", "M12_SME_BZN_ME_MCT_RAT"])
CUSTOMERS = _fields([KEY_MCT, KEY_YM], [*AGE_COLS, "MCT_UE_CLN_REU_RAT", "MCT_UE_CLN_NEW_RAT", *TYPE_COLS])
PREDS = _fields([KEY_MCT, KEY_YM], ["pred_xgb", "pred_lgbm", "pred_rf", "pred_gb", "pred_dl"])
REQUIRED = {"merchants": [KEY_MCT], "usage": [KEY_MCT, KEY_YM], "customers": [KEY_MCT, KEY_YM], "preds": [KEY_MCT, KEY_YM]}
SCHEMAS = {"merchants": MERCHANTS, "usage": USAGE, "customers": CUSTOMERS, "preds": PREDS}


@dataclass
class TypedInput:
    """Rows that fit the schema and have their keys, and the others: reasons and the line as it was."""
    valid: DataFrame
    quarantine: DataFrame


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str], encoding: str | None = None) -> TypedInput:
    """CSV with a header line, in the first encoding that reads it cleanly.

    Columns are matched by name, in any order; a schema column that the file lacks is null in every row, a file column that the
    schema lacks is left out.  A line with too few or too many fields, or with a value that its column's type cannot
    hold, is ``malformed``; a line without one of the ``required`` values lacks its ``missing <column>``."""
    encoding = encoding or detect_encoding(spark, path)
    reader = spark.read.option("header", True).option("encoding", encoding)
    header = reader.csv(path).columns
    types = {f.name: f for f in schema.fields}
    full = T.StructType([types.get(c, T.StructField(c, T.StringType())) for c in header] + [T.StructField(CORRUPT, T.StringType())])
    rows = cut_lineage(reader.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
                       .option("enforceSchema", True).csv(path))
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    checks = [(F.col(CORRUPT).isNotNull(), "malformed")] + [(F.col(CORRUPT).isNull() & empty(c), f"missing {c}") if c in header else (F.lit(True), f"missing {c}")
                                                           for c in required]
    judged = rows.withColumn("reasons", F.filter(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]), lambda x: x.isNotNull()))
    line = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*header)))
    columns = [F.col(f.name) if f.name in header else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return TypedInput(judged.where(F.size("reasons") == 0).select(*columns), judged.where(F.size("reasons") > 0).select("reasons", line.alias("line")))


def read_inputs(spark: SparkSession, paths: dict) -> dict[str, TypedInput]:
    """``paths``: merchants, usage, customers and, if there are predictions, preds."""
    return {name: read_typed_csv(spark, path, SCHEMAS[name], REQUIRED[name]) for name, path in paths.items() if path}


def score_csv(spark: SparkSession, paths: dict, out: str, rejected: str | None = None) -> DataFrame:
    """The batch pipeline from CSV files to a CSV folder (replaced as a whole); broken lines of all inputs go to ``rejected``."""
    inputs = read_inputs(spark, paths)
    preds = inputs["preds"].valid if "preds" in inputs else None
    scored = run_pipeline(inputs["merchants"].valid, inputs["usage"].valid, inputs["customers"].valid, preds=preds)
    replace_folder(scored, out, "csv", header=True)
    if rejected:
        parts = [t.quarantine.select(F.lit(name).alias("input"), F.concat_ws("; ", "reasons").alias("reasons"), "line") for name, t in inputs.items()]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        replace_folder(every, rejected, "csv", header=True)
    return spark.read.option("header", True).schema(scored.schema).csv(out)
