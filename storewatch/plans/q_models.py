"""Model queries (I7, I9-I19, H9, A6/A7). Trained models give rows-only checks; the class prior and the
unweighted-mean slot have SQL oracles."""
from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.constants import ENSEMBLE_WEIGHTS, KEY_MCT, KEY_YM, NUM_FEATURES
from storewatch.operators.ensemble import CONSTANT, ONE_CLASS, fit_logistic
from storewatch.operators.iforest import fit_forest, score_forest
from storewatch.operators.labels import closure_label, label_base, stratified_split
from storewatch.operators.metrics import roc_auc
from storewatch.operators.models import (SLOT_COLUMNS, ModelSizes, encoder_stages, prepare_features,
                                         side_by_side, stacked_score, train_and_score)
from storewatch.operators.reports import minmax_invert
from storewatch.plans.catalog import _PANELS, panel, r6, register
from storewatch.plans.oracle_panel import panel_ctes
from storewatch.plans.oracle_risk import risk_ctes
from storewatch.plans.pipeline import run_pipeline
from storewatch.plans.q_labels import _CL, _LB, _SPLIT
from storewatch.session import cut_lineage, new_folder
from storewatch.sources.files import load_risk_output, read_predictions, write_predictions, write_risk_output

SIZES = ModelSizes()   # the reference's model sizes


def _labeled(spark, sf):
    p = panel(spark, sf)
    lab = closure_label(label_base(p.usage, p.customers), p.merchants)
    return lab, stratified_split(lab.select(KEY_MCT, KEY_YM, "y"))


def _slot_col(slot: str) -> str:
    return SLOT_COLUMNS.get(slot, f"pred_{slot}")


def slot_tables(spark, sf, slots: tuple):
    """Slots trained on the training split and scored on every row, written once per session and set of slots."""
    key = (id(spark), spark.sparkContext.applicationId, sf, "slots", slots)
    if key not in _PANELS:
        lab, split = _labeled(spark, sf)
        out = train_and_score(lab, split, SIZES, slots=slots)
        _PANELS[key] = out.select(KEY_MCT, KEY_YM, "y", "is_train", "is_test", *[_slot_col(s) for s in slots])
    return _PANELS[key]


def slot_table(spark, sf, slot: str):
    return slot_tables(spark, sf, (slot,))


def all_slots(spark, sf):
    return slot_tables(spark, sf, tuple(SLOT_COLUMNS))


def _slot_query(slot: str):
    col = _slot_col(slot)

    def q(spark, sf):
        return slot_table(spark, sf, slot).select(KEY_MCT, KEY_YM, "y", "is_test", *r6(col))
    q.__doc__ = f"Train the {slot} slot on the training split, probability for every row."
    return q


register("model_rf")(_slot_query("rf"))
register("model_gbt")(_slot_query("gb"))
register("model_gbt_a")(_slot_query("xgb"))
register("model_gbt_b")(_slot_query("lgbm"))
register("model_mlp")(_slot_query("dl"))
register("model_logit")(_slot_query("logit"))


_CATS = ["HPSN_MCT_ZCD_NM", "HPSN_MCT_BZN_CD_NM"]
_UNSEEN = "HPSN_MCT_ZCD_NM NOT IN ('0', '7')"    # categories that the fit never sees


def _slots_sql(c: str) -> str:
    return f"""s_{c} AS (SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, {c}) AS slot FROM oh WHERE fit GROUP BY {c})"""


def _vector_sql(c: str) -> str:
    return (f"(SELECT string_agg(CASE WHEN s.{c} = oh.{c} THEN '1' ELSE '0' END, ',' ORDER BY s.slot) FROM s_{c} s) AS {c}_onehot")


@register("one_hot", f"""WITH {panel_ctes()}, {_SPLIT},
oh AS (SELECT sp.ENCODED_MCT, sp.TA_YM, m.HPSN_MCT_ZCD_NM, m.HPSN_MCT_BZN_CD_NM, sp.is_test = 0 AND {_UNSEEN} AS fit
  FROM sp JOIN ds1 m ON sp.ENCODED_MCT = m.ENCODED_MCT),
{_slots_sql(_CATS[0])}, {_slots_sql(_CATS[1])}
SELECT ENCODED_MCT, TA_YM, HPSN_MCT_ZCD_NM, HPSN_MCT_BZN_CD_NM, {_vector_sql(_CATS[0])}, {_vector_sql(_CATS[1])} FROM oh""")
def q_one_hot(spark, sf):
    """Industry / area one-hot fitted on the training split without two industries: slots by frequency, then name;
    the unseen industries -> zeros. Vectors as text, one digit per slot."""
    lab, split = _labeled(spark, sf)
    cats = panel(spark, sf).merchants.select(KEY_MCT, *_CATS)
    d = lab.select(KEY_MCT, KEY_YM).join(cats, KEY_MCT).join(split.select(KEY_MCT, KEY_YM, "is_train"), [KEY_MCT, KEY_YM])
    model = Pipeline(stages=encoder_stages(_CATS)).fit(d.where(f"is_train = 1 AND {_UNSEEN}"))
    out = model.transform(d)
    digits = lambda c: F.concat_ws(",", F.transform(vector_to_array(f"{c}__oh"), lambda x: x.cast("int").cast("string")))
    return out.select(KEY_MCT, KEY_YM, *_CATS, *[digits(c).alias(f"{c}_onehot") for c in _CATS])


def _trained_output(spark, sf):
    """All five slots -> predictions sink (by month, rows without a key left out), read back, and the scoring pipeline rerun with them
    into the risk output sink, read back; the folders are kept for the session."""
    key = (id(spark), spark.sparkContext.applicationId, sf, "trained")
    if key not in _PANELS:
        base = new_folder(spark, "trained")
        write_predictions(all_slots(spark, sf), f"{base}/predictions")
        preds = read_predictions(spark, f"{base}/predictions")
        p = panel(spark, sf)
        write_risk_output(run_pipeline(p.merchants, p.usage, p.customers, preds=preds), f"{base}/risk_output")
        _PANELS[key] = (preds, load_risk_output(spark, f"{base}/risk_output"))
    return _PANELS[key]


@register("preds_output")
def q_preds_output(spark, sf):
    """Risk output with the trained models' predictions, from the predictions sink to the risk output sink."""
    return _trained_output(spark, sf)[1].drop("month")


@register("preds_output_facts", f"""WITH {risk_ctes()}
SELECT COUNT(*) AS n, COUNT(DISTINCT TA_YM) AS n_months, ROUND(SUM(RiskScore), 4) AS sum_risk, COUNT(*) AS n_predictions, 0 AS blend_off, 0 AS alert_off FROM risks""")
def q_preds_output_facts(spark, sf):
    """What must hold of the trained output whatever the models learned: a row per store-month, rule scores as without models, the
    blend of the stored predictions, alerts in order of the scores within a month."""
    preds, out = _trained_output(spark, sf)
    stored = out.join(preds, [KEY_MCT, KEY_YM], "left")
    model = sum(F.lit(w) * F.col(SLOT_COLUMNS[t]) for t, w in ENSEMBLE_WEIGHTS.items())
    off = F.abs(F.lit(0.6) * F.greatest(F.least(model, F.lit(1.0)), F.lit(0.0)) + F.lit(0.4) * F.col("RiskScore") - F.col("p_final")) > 1e-9
    level = F.array_position(F.array(*[F.lit(a) for a in ("GREEN", "YELLOW", "ORANGE", "RED")]), F.col("Alert"))
    spans = out.groupBy(KEY_YM, level.alias("level")).agg(F.min("p_final").alias("lo"), F.max("p_final").alias("hi"))
    wrong = spans.alias("a").join(spans.alias("b"), [KEY_YM]).where("a.level < b.level and a.hi >= b.lo").agg(F.count(F.lit(1))).scalar()
    return stored.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(KEY_YM).alias("n_months"), F.round(F.sum("RiskScore"), 4).alias("sum_risk"),
                      F.count("pred_dl").alias("n_predictions"), F.count(F.when(F.coalesce(off, F.lit(True)), 1)).alias("blend_off")).withColumn("alert_off", wrong.cast("int"))


_STEPS = 12


def _newton(name: str, source: str) -> str:
    """CTEs that fit ``source`` (s, y) by Newton steps of one aggregate each; the last is ``<name>`` (a, b)."""
    parts = [f"{name}0 AS (SELECT 0.0::DOUBLE AS a, ln(avg(y) / (1 - avg(y))) AS b FROM {source})"]
    for i in range(_STEPS):
        parts.append(f"""{name}h{i} AS MATERIALIZED (SELECT any_value(a) AS a, any_value(b) AS b, sum((p - y) * s) + any_value(a) AS ga, sum(p - y) AS gb,
  sum(p * (1 - p) * s * s) + 1 AS haa, sum(p * (1 - p) * s) AS hab, sum(p * (1 - p)) AS hbb
  FROM (SELECT s, y, a, b, 1 / (1 + exp(-(a * s + b))) AS p FROM {source}, {name}{i}))""")
        parts.append(f"""{name}{i + 1 if i + 1 < _STEPS else ''} AS (SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a,
  b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM {name}h{i})""")
    return ", ".join(parts)


_STACK = f"""{_SPLIT}, st AS (SELECT sp.ENCODED_MCT, sp.TA_YM, sp.y, sp.is_test,
  {" + ".join(f"{w} * p.{SLOT_COLUMNS[t]}" for t, w in ENSEMBLE_WEIGHTS.items())} AS stack
  FROM sp JOIN preds p ON sp.ENCODED_MCT = p.ENCODED_MCT AND sp.TA_YM = p.TA_YM)"""


def _stacked(spark, sf):
    """Keys, label, split and the weighted sum of the five given model scores."""
    lab, split = _labeled(spark, sf)
    preds = panel(spark, sf).preds
    return split.join(preds, [KEY_MCT, KEY_YM]).select(KEY_MCT, KEY_YM, "y", "is_test", stacked_score(preds).alias("stack"))


@register("platt_logistic", f"""WITH {panel_ctes()}, {_STACK}, tr AS MATERIALIZED (SELECT stack AS s, y FROM st WHERE is_test = 1), {_newton('f', 'tr')}
SELECT ENCODED_MCT, TA_YM, y, ROUND(stack, 6) AS stack, ROUND(1 / (1 + exp(-(a * stack + b))), 6) AS p_cal FROM st, f""")
def q_platt_logistic(spark, sf):
    """Logistic calibration of the stacked score of the given predictions, fitted on the test split (as the original)."""
    d = cut_lineage(_stacked(spark, sf))
    fitted = fit_logistic(d.where("is_test = 1"), "stack", "y")
    return d.select(KEY_MCT, KEY_YM, "y", *r6("stack"), F.round(fitted.transform("stack"), 6).alias("p_cal"))


_CASES = {"constant": "0.25", "one class": "stack", "missing": "CASE WHEN CAST(ENCODED_MCT AS BIGINT) % 3 = 0 THEN CAST('nan' AS DOUBLE) "
          "WHEN CAST(ENCODED_MCT AS BIGINT) % 3 = 1 THEN NULL ELSE stack END"}
_FINITE = "CASE WHEN isfinite(x) THEN x ELSE (SELECT coalesce(median(x) FILTER (WHERE isfinite(x)), 0.5) FROM ms) END"


@register("platt_logistic_cases", f"""WITH {panel_ctes()}, {_STACK}, ms AS (SELECT {_CASES['missing']} AS x, y FROM st WHERE is_test = 1),
tr AS MATERIALIZED (SELECT {_FINITE} AS s, y FROM ms), {_newton('f', 'tr')}
SELECT 'constant' AS kind, '{CONSTANT}' AS note, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b, 0.25 AS mean_p FROM (SELECT 1)
UNION ALL SELECT 'one class', '{ONE_CLASS}', NULL, NULL, ROUND(avg(stack), 6) FROM st WHERE is_test = 1
UNION ALL SELECT 'missing', NULL, ROUND(any_value(a), 6), ROUND(any_value(b), 6), ROUND(avg(1 / (1 + exp(-(a * s + b)))), 6) FROM tr, f""")
def q_platt_logistic_cases(spark, sf):
    """The calibration's rules on the test split: constant scores and a single class are left alone, scores that are missing or not
    numbers count as the median."""
    test = cut_lineage(_stacked(spark, sf).where("is_test = 1"))
    parts = []
    for kind, score in _CASES.items():
        rows = test.select(F.expr(score).cast("double").alias("s"), (F.lit(0) if kind == "one class" else F.col("y")).alias("y"))
        fitted = fit_logistic(rows, "s", "y")
        number = lambda v: F.round(F.lit(v).cast("double"), 6)
        parts.append(rows.agg(F.round(F.avg(fitted.transform("s")), 6).alias("mean_p")).select(
            F.lit(kind).alias("kind"), F.lit(fitted.note).cast("string").alias("note"), number(fitted.a).alias("a"), number(fitted.b).alias("b"), "mean_p"))
    return reduce(DataFrame.unionByName, parts)


@register("isolation_forest")
def q_isolation_forest(spark, sf):
    """Unsupervised fallback: isolation forest on the numeric features, score min-max inverted as the
    original does with ``score_samples``."""
    lab, split = _labeled(spark, sf)
    (feats,) = prepare_features(lab, [lab.select(KEY_MCT, KEY_YM, *NUM_FEATURES)], NUM_FEATURES, [])
    feats = cut_lineage(feats)
    forest = cut_lineage(fit_forest(feats, NUM_FEATURES, [KEY_MCT, KEY_YM], n_trees=400, sample_size=256))
    scored = cut_lineage(score_forest(feats, forest, NUM_FEATURES, out="anomaly"))   # its least and largest score are asked before its rows
    normal = scored.withColumn("normality", -F.col("anomaly"))
    return minmax_invert(normal, "normality", out="pe").select(KEY_MCT, KEY_YM, *r6("anomaly", "pe"))


@register("model_prior", f"""WITH {panel_ctes()}, {_SPLIT}
SELECT ENCODED_MCT, TA_YM, ROUND((SELECT AVG(y) FROM sp WHERE is_test = 0), 6) AS p_prior FROM sp""")
def q_model_prior(spark, sf):
    """Prior-class fallback: the training positive rate for every row."""
    lab, split = _labeled(spark, sf)
    prior = split.where("is_train = 1").select(F.avg("y")).scalar()
    return split.select(KEY_MCT, KEY_YM, F.round(prior, 6).alias("p_prior"))


@register("mean_ensemble", f"""WITH {panel_ctes()}
SELECT ENCODED_MCT, TA_YM, ROUND((pred_xgb + pred_lgbm + pred_rf + pred_gb + pred_dl) / 5.0, 6) AS pred_rf,
  CAST(NULL AS DOUBLE) AS p_model FROM preds""")
def q_mean_ensemble(spark, sf):
    """Unweighted mean of the model columns written into the ``pred_rf`` slot, the other slots left
    missing; the weighted ensemble then sees missing values and yields no model score."""
    from storewatch.operators.ensemble import weighted_ensemble
    p = panel(spark, sf).preds
    mean = (F.col("pred_xgb") + F.col("pred_lgbm") + F.col("pred_rf") + F.col("pred_gb") + F.col("pred_dl")) / 5.0
    slots = p.select(KEY_MCT, KEY_YM, mean.alias("pred_rf"), *[F.lit(None).cast("double").alias(c) for c in
                                                               ("pred_xgb", "pred_lgbm", "pred_gb", "pred_dl")])
    return slots.select(KEY_MCT, KEY_YM, F.round("pred_rf", 6).alias("pred_rf"),
                        weighted_ensemble(slots).alias("p_model"))


_FIVE = tuple(SLOT_COLUMNS.values())


@register("one_class_slots", f"""WITH {panel_ctes()}, {_LB}
SELECT COUNT(*) AS n, 1 AS all_slots_equal, 0.0 AS lowest, 1.0 AS highest, 0 AS missing FROM lb""")
def q_one_class_slots(spark, sf):
    """Facts of scoring when no store ever closes (all labels negative): the five slots hold one unusualness score."""
    lab, split = _labeled(spark, sf)
    out = train_and_score(lab.withColumn("y", F.lit(0)), split, SIZES)
    same = F.min((F.least(*_FIVE) == F.greatest(*_FIVE)).cast("int"))
    return out.agg(F.count(F.lit(1)).alias("n"), same.alias("all_slots_equal"), F.round(F.min(_FIVE[0]), 6).alias("lowest"),
                   F.round(F.max(_FIVE[0]), 6).alias("highest"), F.count(F.when(F.col(_FIVE[0]).isNull(), 1)).alias("missing"))


_FACTS = """SELECT '{c}' AS slot, (SELECT COUNT(*) FROM sp) AS n, 0 AS outside, (SELECT COUNT(DISTINCT (ENCODED_MCT, TA_YM)) FROM sp) AS n_keys,
  1 AS beats_chance, 1 AS rerun_equal"""


def _facts(t, c: str):
    facts = t.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > 1), 1)).alias("outside"),
                  F.countDistinct(KEY_MCT, KEY_YM).alias("n_keys"))
    auc = roc_auc(t.where("is_train = 1"), c, "y").select((F.col("roc_auc") > 0.5).cast("int")).scalar()
    return facts.select(F.lit(c).alias("slot"), "n", "outside", "n_keys", auc.alias("beats_chance"))


def _slot_facts(slot: str):
    c = _slot_col(slot)

    def q(spark, sf):
        lab, split = _labeled(spark, sf)
        t, again = side_by_side([lambda: slot_table(spark, sf, slot), lambda: train_and_score(lab, split, SIZES, slots=(slot,))])
        again = again.select(KEY_MCT, KEY_YM, F.col(c).alias("again"))
        off = t.join(again, [KEY_MCT, KEY_YM], "left").agg(F.max(F.coalesce(F.abs(F.col(c) - F.col("again")), F.lit(1.0))))
        return _facts(t, c).withColumn("rerun_equal", (F.lit(off.first()[0]) <= 1e-9).cast("int"))
    q.__doc__ = f"What must hold of the {slot} slot: a probability per key, better than chance on the training split, the same when trained again."
    return q


for _slot in (*SLOT_COLUMNS, "logit"):
    register(f"model_facts_{_slot}", f"WITH {panel_ctes()}, {_SPLIT} " + _FACTS.format(c=_slot_col(_slot)))(_slot_facts(_slot))


@register("model_facts", f"""WITH {panel_ctes()}, {_SPLIT}
SELECT slot, (SELECT COUNT(*) FROM sp) AS n, 0 AS outside, (SELECT COUNT(DISTINCT (ENCODED_MCT, TA_YM)) FROM sp) AS n_keys,
  1 AS beats_chance, 1 AS differs_from_others FROM (VALUES ('pred_xgb'), ('pred_lgbm'), ('pred_rf'), ('pred_gb'), ('pred_dl')) s(slot)""")
def q_model_facts(spark, sf):
    """What must hold of every trained slot: one probability in [0, 1] per key, better than chance on the training
    split, not the same numbers as another slot."""
    t = all_slots(spark, sf)
    parts = []
    for c in _FIVE:
        differs = t.agg(F.least(*[F.max((F.abs(F.col(c) - F.col(o)) > 1e-6).cast("int")) for o in _FIVE if o != c]))
        parts.append(_facts(t, c).withColumn("differs_from_others", differs.scalar()))
    return reduce(DataFrame.unionByName, parts)
