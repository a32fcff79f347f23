"""What a store-month's RiskScore is made of: the thirteen weighted terms of the three components, and what to look at first."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.constants import ALPHA, BETA, BIN_COLS, GAMMA, KEY_MCT, KEY_YM
from storewatch.operators.risk import (INPUT_COLS, risk_inputs, risk_score_expr, with_customer_risk, with_market_risk,
                                       with_sales_risk)
from storewatch.operators.trends import severity

# fixed values: the terms of each component and their weights in it; the insight of each term is this library's own text
TERMS = [
    ("Sales_Risk", "sales_drop", 0.35, "_s_drop", "sales or visits fell against the month before"),
    ("Sales_Risk", "ticket_drop", 0.15, "_s_aov", "the average ticket is below its usual level"),
    ("Sales_Risk", "cancellations", 0.20, "_s_cxl", "cancellations are high"),
    ("Sales_Risk", "peer_rank", 0.20, "_s_peer", "sales rank low among peers"),
    ("Sales_Risk", "delivery_shift", 0.10, "_dlv * _jump", "the delivery share moved on a large base"),
    ("Customer_Risk", "customer_drop", 0.40, "_c_drop", "customers fell against the month before or their usual number"),
    ("Customer_Risk", "loyalty_drop", 0.25, "_c_loyal", "fewer customers return"),
    ("Customer_Risk", "acquisition_drop", 0.20, "_c_acq", "fewer customers are new"),
    ("Customer_Risk", "age_concentration", 0.10, "_c_mix", "customers concentrate on few age groups"),
    ("Customer_Risk", "type_concentration", 0.05, "_c_type", "customers concentrate on one kind of visit"),
    ("Market_Risk", "closures", 0.50, "_m_closure", "many stores of the industry or area close"),
    ("Market_Risk", "underperformance", 0.35, "_m_under", "sales are below those of the industry"),
    ("Market_Risk", "store_age", 0.15, "_m_age", "the store is in its middle age"),
]
COMPONENT_WEIGHTS = {"Sales_Risk": ALPHA, "Customer_Risk": BETA, "Market_Risk": GAMMA}
INSIGHTS, LEAST_SHARE = 3, 0.02


def risk_factors(df: DataFrame, boundary: str = "store") -> DataFrame:
    """Keys, the component scores, RiskScore, ``factors`` (array of component, factor, value, weight, contribution; largest contribution
    first, ties by order of the terms) and ``insights`` (texts of up to three terms that contribute 0.02 or more).

    ``df``: joined rows with ranks, as for ``compute_all_risks``.  Terms lie in [0, 1] and a component's weights add up to one, so the
    component's clip never binds: contributions add up to RiskScore."""
    needed = [KEY_MCT, KEY_YM, *[f"{c}_RANK" for c in BIN_COLS], *INPUT_COLS]
    df = df.select(*[c for c in dict.fromkeys(needed) if c in df.columns])
    d = with_market_risk(with_customer_risk(with_sales_risk(risk_inputs(df, boundary=boundary), df)), df).withColumn("RiskScore", risk_score_expr())
    if boundary == "global":
        d = d.where(~F.col("_halo"))
    d = d.withColumn("_values", F.array(*[F.expr(term) for _, _, _, term, _ in TERMS]))   # every term once; the rest refers to it by place
    fixed = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(name).alias("factor"), F.lit(w).alias("weight"),
                               F.lit(COMPONENT_WEIGHTS[c] * w).alias("share"), F.lit(text).alias("insight")) for c, name, w, _, text in TERMS])

    def entry(v, i):
        f = F.get(fixed, i)
        return F.struct((-F.round(f["share"] * v, 9)).alias("less"), i.alias("place"), f["component"].alias("component"), f["factor"].alias("factor"),
                        v.alias("value"), f["weight"].alias("weight"), (f["share"] * v).alias("contribution"), f["insight"].alias("insight"))
    terms = F.transform("_values", entry)
    d = d.withColumn("_terms", F.sort_array(terms))
    told = F.transform(F.slice(F.filter("_terms", lambda t: t["less"] <= -LEAST_SHARE), 1, INSIGHTS), lambda t: t["insight"])
    factors = F.transform("_terms", lambda t: F.struct(t["component"].alias("component"), t["factor"].alias("factor"), t["value"].alias("value"),
                                                       t["weight"].alias("weight"), t["contribution"].alias("contribution")))
    return d.select(KEY_MCT, KEY_YM, *COMPONENT_WEIGHTS, "RiskScore", severity(F.col("RiskScore")).alias("severity"), factors.alias("factors"),
                    told.alias("insights"))
