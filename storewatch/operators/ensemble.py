"""Model ensemble, Platt calibration (least squares and logistic) and the final blend."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewatch.constants import ENSEMBLE_ALIASES, ENSEMBLE_WEIGHTS, LAMBDA_BLEND
from storewatch.functions.core import clip01, logistic, logit
from storewatch.operators.ranking import global_quantiles


def model_columns(columns: list) -> dict:
    """tag -> first column whose lower-case name contains one of the tag's aliases (plan-time lookup)."""
    found = {}
    for tag, aliases in ENSEMBLE_ALIASES.items():
        hits = [c for c in columns if any(a in c.lower() for a in aliases)]
        if hits:
            found[tag] = hits[0]
    return found


def weighted_ensemble(df: DataFrame, renormalize: bool = False) -> Column:
    """Weighted sum of the available model columns, clipped to [0,1]. Absent models are skipped; with
    ``renormalize`` the remaining weights are rescaled to sum to one. A missing value makes the result
    missing."""
    cols = model_columns(df.columns)
    if not cols:
        return F.lit(0.0)
    total = sum(ENSEMBLE_WEIGHTS[t] for t in cols) if renormalize else 1.0
    terms = [F.lit(ENSEMBLE_WEIGHTS[t] / total) * F.col(c).cast("double") for t, c in cols.items()]
    return clip01(sum(terms[1:], terms[0]))


@dataclass
class Platt:
    a: Column
    b: Column

    def transform(self, p) -> Column:
        return clip01(logistic(self.a * logit(p) + self.b))


def platt_lstsq_params(df: DataFrame, p_col: str, y_col: str) -> DataFrame:
    """Least-squares fit of y ~ b + a * logit(clip(p)) as a one-row DataFrame (a, b).

    Closed form from one aggregate. A constant score has no unique solution; the minimum-norm one is
    b = ybar / (1 + c^2), a = ybar * c / (1 + c^2) with c the constant logit."""
    x = logit(p_col)
    y = F.col(y_col).cast("double")
    d = df.where(F.col(p_col).isNotNull() & F.col(y_col).isNotNull()).select(x.alias("x"), y.alias("y"))
    agg = d.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("xbar"), F.avg("y").alias("ybar"),
                F.var_pop("x").alias("vx"), F.covar_pop("x", "y").alias("cxy"))
    c2 = F.col("xbar") * F.col("xbar")
    const = F.col("vx") <= F.lit(1e-18)
    slope = F.when(const, F.col("ybar") * F.col("xbar") / (F.lit(1.0) + c2)).otherwise(F.col("cxy") / F.col("vx"))
    inter = F.when(const, F.col("ybar") / (F.lit(1.0) + c2)).otherwise(F.col("ybar") - slope * F.col("xbar"))
    return agg.select(slope.alias("a"), inter.alias("b"), "n")


def calibrate_lstsq(df: DataFrame, p_col: str, y_col: str, out_col: str = "p_cal") -> DataFrame:
    """Fit on ``df`` and transform every row. The two parameters travel as scalar subqueries."""
    params = platt_lstsq_params(df, p_col, y_col)
    platt = Platt(params.select("a").scalar(), params.select("b").scalar())
    return df.withColumn(out_col, platt.transform(p_col))


@dataclass
class Calibration:
    """P(y = 1) = logistic(a * score + b); without a and b the score is kept (``note`` says why).  ``fill`` stands for scores that are
    missing or not finite."""
    a: float | None
    b: float | None
    fill: float
    note: str | None = None

    def transform(self, score: str) -> Column:
        x = finite_or(F.col(score), self.fill)
        return x if self.a is None else F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.a) * x + F.lit(self.b))))


CONSTANT, ONE_CLASS = "constant scores; skip calibration", "single-class; skip calibration"


def finite_or(x: Column, fill: float) -> Column:
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(ok, x).otherwise(F.lit(fill))


def fit_logistic(df: DataFrame, score: str, label: str, penalty: float = 1.0, steps: int = 50, tolerance: float = 1e-12) -> Calibration:
    """Logistic calibration: least sum of cross-entropies + penalty * a^2 / 2, by Newton steps.

    A step is one aggregate of the table (loss, gradient and the 2 x 2 matrix of second derivatives at the current a and b); a step
    that does not lower the loss is halved.  Rows without a label are left out; scores that are missing or not finite count as the
    median of the others (0.5 if there are none); all (nearly) equal scores, or labels of one class, are not calibrated."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y"))
    known = rows.where(finite_or(F.col("s"), float("nan")).isNotNull() & ~F.isnan(finite_or(F.col("s"), float("nan"))))
    (middle,) = global_quantiles(known, "s", [0.5])
    fill = rows.sparkSession.range(1).select(F.coalesce(middle, F.lit(0.5))).first()[0]
    rows = rows.withColumn("s", finite_or(F.col("s"), fill))
    seen = rows.agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.countDistinct("y").alias("classes"), F.avg("y").alias("mean")).first()
    if seen.lo is None or seen.hi - seen.lo <= 1e-8 + 1e-5 * abs(seen.lo):
        return Calibration(None, None, fill, CONSTANT)
    if seen.classes < 2:
        return Calibration(None, None, fill, ONE_CLASS)

    def at(a: float, b: float) -> tuple:
        z = F.lit(a) * F.col("s") + F.lit(b)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        w = p * (F.lit(1.0) - p)
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z
        return rows.agg(F.sum(loss), F.sum((p - F.col("y")) * F.col("s")), F.sum(p - F.col("y")), F.sum(w * F.col("s") * F.col("s")),
                        F.sum(w * F.col("s")), F.sum(w)).first()

    a, b, move, best = 0.0, math.log(seen.mean / (1 - seen.mean)), (0.0, 0.0), math.inf
    for _ in range(steps):
        loss, ga, gb, haa, hab, hbb = at(a, b)
        loss += penalty * a * a / 2
        if loss > best + 1e-9 * abs(best):
            move = (move[0] / 2, move[1] / 2)
            a, b = a - move[0], b - move[1]
            continue
        best = loss
        ga, haa = ga + penalty * a, haa + penalty
        det = haa * hbb - hab * hab
        move = (-(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det)
        if max(abs(m) for m in move) <= tolerance * (1 + abs(a) + abs(b)):
            break
        a, b = a + move[0], b + move[1]
    return Calibration(a, b, fill)


def blend(p_model: Column, risk_score: Column, lam: float = LAMBDA_BLEND) -> Column:
    """lam * p_model + (1 - lam) * RiskScore, missing -> 0."""
    return (F.lit(lam) * F.coalesce(p_model, F.lit(0.0))
            + F.lit(1.0 - lam) * F.coalesce(risk_score, F.lit(0.0)))
