"""Feature frame, one-hot encoding and the model ensemble.

The slots are the learners of ``boosting`` (leaf-wise and depth-limited boosted trees), ``forest`` (fully grown trees) and ``neural``
(a network with dropout), and Spark ML's logistic regression.  Features are imputed, encoded and written once for all slots; a
table whose rows a task can hold is learned from inside tasks, one a slot, a larger one by one aggregate per step, all slots side by side.
Scoring is one pass over the rows with the models of all slots but the forest, whose tasks score the rows that they hold.
"""
from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.constants import CAT_FEATURES, ENSEMBLE_WEIGHTS, KEY_MCT, KEY_YM, NUM_FEATURES
from storewatch.operators import boosting, forest, neural
from storewatch.operators.blocks import fit_in_task, to_blocks
from storewatch.operators.iforest import fit_forest, score_forest
from storewatch.operators.metrics import fit_medians, impute_medians
from storewatch.operators.reports import minmax_invert
from storewatch.session import Scope, cut_lineage

#: Rows up to which a boosted slot is fitted within a task: some 100 bytes each.  A job a wave costs more than the rows' work until then.
TASK_ROWS = 1 << 22
#: The same for the network, whose features lie there as doubles: some 350 bytes a row.
NETWORK_ROWS = 1 << 20

# slot -> output column of the predictions table
SLOT_COLUMNS = {"xgb": "pred_xgb", "lgbm": "pred_lgbm", "rf": "pred_rf", "gb": "pred_gb", "dl": "pred_dl"}


@dataclass
class ModelSizes:
    """Sizes of the original's models; tests pass small ones."""
    rf_trees: int = 400
    gb_rounds: int = 100
    xgb_rounds: int = 400
    lgbm_rounds: int = 500
    dl_epochs: int = 10
    extra: dict = field(default_factory=dict)


def feature_columns(df: DataFrame) -> tuple[list, list]:
    num = [c for c in NUM_FEATURES if c in df.columns]
    cat = [c for c in CAT_FEATURES if c in df.columns]
    return num, cat


def encoder_stages(cat: list) -> list:
    """Categorical -> index by frequency (unseen -> one extra, last index) -> one-hot without the last slot, so an
    unseen category encodes as all zeros."""
    stages = []
    for c in cat:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"{c}__idx", outputCol=f"{c}__oh", handleInvalid="error", dropLast=True))
    return stages


def prepare_features(train: DataFrame, frames: list, num: list, cat: list) -> list:
    """Median-impute numeric columns with medians fitted on ``train``; returns the frames imputed."""
    med = fit_medians(train, num)
    return [impute_medians(f, med, num) for f in frames]


def class_weight_col(train: DataFrame, y: str = "y") -> DataFrame:
    """"balanced" weights n / (2 * n_c), joined from a two-row table."""
    n = train.select(F.count(F.lit(1))).scalar()
    w = train.groupBy(y).agg((n / (F.lit(2.0) * F.count(F.lit(1)))).alias("w"))
    return train.join(F.broadcast(w), y)


def boosting_of(slot: str, sizes: ModelSizes, seed: int = 42) -> boosting.Boosting:
    """Settings of the three boosted slots.  Rows are sampled in the xgb slot only: the lgbm slot sets no sampling frequency."""
    if slot == "gb":
        return boosting.Boosting(sizes.gb_rounds, 0.1, leaves=8, depth=3, seed=seed)
    if slot == "xgb":
        return boosting.Boosting(sizes.xgb_rounds, 0.05, leaves=32, depth=5, min_hessian=1.0, l2=1.0, row_share=0.8, column_share=0.8, seed=seed)
    if slot == "lgbm":
        return boosting.Boosting(sizes.lgbm_rounds, 0.05, leaves=31, min_rows=20, min_hessian=1e-3, column_share=0.8, seed=seed)
    raise KeyError(slot)


def encode_features(data: DataFrame, train: DataFrame, num: list, cat: list) -> DataFrame:
    """``data`` with ``x``: numeric columns, then one-hot slots of the categories that ``train`` has."""
    assembler = VectorAssembler(inputCols=num + [f"{c}__oh" for c in cat], outputCol="features", handleInvalid="keep")
    made = Pipeline(stages=encoder_stages(cat) + [assembler]).fit(train).transform(data)
    return made.select(*data.columns, vector_to_array("features").alias("x"))


def fit_slots(blocks: DataFrame, train: DataFrame, slots: tuple, sizes: ModelSizes, task_rows: int = TASK_ROWS) -> dict:
    """Models with ``predict(rows of x)`` of the given slots but the forest; ``blocks``: those of ``train`` (x and y, with both classes)."""
    width = len(train.select("x").first()[0])
    boosted = [s for s in slots if s in ("gb", "xgb", "lgbm")]
    cuts = boosting.quantile_cuts(train, width) if boosted else []
    network = neural.Training(epochs=sizes.dl_epochs)
    n = blocks.agg(F.sum("n")).first()[0]
    small: dict = {}
    fits: dict = {}
    for s in boosted:
        p = boosting_of(s, sizes)
        if n <= task_rows:  # the same steps without a job for each
            small[s] = lambda rows, p=p: boosting.boost_in_task(rows, cuts, p)
        else:
            fits[s] = lambda s=s, p=p: {s: boosting.boost_blocks(blocks, cuts, p)}
    if "dl" in slots:
        if n <= min(task_rows, NETWORK_ROWS):
            small["dl"] = lambda rows: neural.train_in_task(rows, network)
        else:
            fits["dl"] = lambda: {"dl": neural.train_blocks(blocks, width, network)}
    if small:
        fits["small"] = lambda: fit_in_task(blocks, small, whole=True)
    models: dict = {}
    for made in side_by_side(list(fits.values())):
        models |= made
    return models


def side_by_side(calls: list) -> list:
    """Results of calls that submit jobs of their own, made at the same time: the short jobs of one fill the gaps of another."""
    if len(calls) < 2:
        return [f() for f in calls]
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(f) for f in calls]]


def score_slots(data: DataFrame, models: dict) -> DataFrame:
    """``data`` without x, and each model's P(y = 1) of its x in its slot's column."""
    spark, names = data.sparkSession, list(models)
    shared = spark.sparkContext.broadcast(models)  # sizes are bounded by the models' settings
    columns = [SLOT_COLUMNS.get(s, f"pred_{s}") for s in names]
    kept = [c for c in data.columns if c != "x"]
    ddl = ", ".join(f"{c} {data.schema[c].dataType.simpleString()}" for c in kept) + "".join(f", {c} double" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                made = {c: np.asarray(shared.value[s].predict(x), float) for s, c in zip(names, columns, strict=True)}
                yield pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in kept}, **made})

    return data.mapInArrow(run, ddl)


def score_logistic(data: DataFrame, train: DataFrame, out: str) -> DataFrame:
    """Balanced logistic regression of Spark ML on ``x``."""
    vector = lambda df: df.withColumn("features", array_to_vector("x"))
    model: PipelineModel = Pipeline(stages=[LogisticRegression(maxIter=200, weightCol="w", labelCol="y")]).fit(vector(class_weight_col(train)))
    return model.transform(vector(data)).withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def stacked_score(df: DataFrame, renormalize: bool = True) -> F.Column:
    cols = {t: c for t, c in SLOT_COLUMNS.items() if c in df.columns}
    total = sum(ENSEMBLE_WEIGHTS[t] for t in cols) if renormalize else 1.0
    terms = [F.lit(ENSEMBLE_WEIGHTS[t] / total) * F.col(c) for t, c in cols.items()]
    return sum(terms[1:], terms[0])


def one_class_slots(data: DataFrame, num: list, slots=tuple(SLOT_COLUMNS), n_trees: int = 400) -> DataFrame:
    """Scores without a second class to learn from: how unusual a row is (isolation forest, normality min-max
    inverted to 0..1), the same in every slot."""
    forest = cut_lineage(fit_forest(data, num, [KEY_MCT, KEY_YM], n_trees=n_trees))
    scored = score_forest(data, forest, num, out="anomaly").withColumn("normality", -F.col("anomaly"))
    unusual = minmax_invert(cut_lineage(scored), "normality", out="_pe")
    columns = {SLOT_COLUMNS.get(s, f"pred_{s}"): F.col("_pe") for s in slots}
    return unusual.withColumns(columns).drop("anomaly", "normality", "_pe")


def train_and_score(labeled: DataFrame, split: DataFrame, sizes: ModelSizes, slots=tuple(SLOT_COLUMNS)) -> DataFrame:
    """Fit every slot on the training split and score every row: a written table of keys, label, split and pred_* columns; the tables in between
    are dropped.  A training split of one class gets the unusualness of each row in all slots (:func:`one_class_slots`)."""
    num, cat = feature_columns(labeled)
    data = labeled.select(KEY_MCT, KEY_YM, "y", *num, *cat).join(
        split.select(KEY_MCT, KEY_YM, "is_train", "is_test"), [KEY_MCT, KEY_YM])
    (full,) = prepare_features(data.where("is_train = 1"), [data], num, cat)
    keys = [KEY_MCT, KEY_YM]
    with Scope(full.sparkSession) as scope:
        full = scope.table(full)
        train = full.where("is_train = 1")
        if train.agg(F.countDistinct("y")).first()[0] < 2:
            return cut_lineage(one_class_slots(full, num, slots))
        coded = scope.table(encode_features(full, train, num, cat).select(*keys, "y", "is_train", "is_test", "x"))
        train = coded.where("is_train = 1")
        trees, own = "rf" in slots, tuple(s for s in slots if s not in ("logit", "rf"))
        calls = []
        if trees or own:
            blocks = scope.table(to_blocks(train, keys, texts=trees))
        if own:
            calls.append(lambda: fit_slots(blocks.drop("texts"), train, own, sizes))
        if trees:
            rest = to_blocks(coded.where("is_train = 0"), keys, texts=True).withColumn("bucket", F.lit(forest.REST) - F.col("bucket"))
            every = blocks.unionByName(scope.table(rest))
            calls.append(lambda: scope.table(forest.forest_scores(every, sizes.rf_trees)))
        made = side_by_side(calls)
        out = score_logistic(coded, train, SLOT_COLUMNS.get("logit", "pred_logit")) if "logit" in slots else coded
        out = score_slots(out, made[0]) if own else out.drop("x")
        if trees:
            scores = made[-1].select(F.col("k").alias("_k"), F.col("score").alias(SLOT_COLUMNS["rf"]))
            out = out.withColumn("_k", F.to_json(F.struct(*keys))).join(scores, "_k", "left").drop("_k")
        return cut_lineage(out)
