"""Merchant / usage / customer / prediction tables derived from the order tables.

Store = supplier, month = ship month. Lines are first combined to (store, month, customer) grain — the
only grain at which a window is used (a customer's first month at a store; at most one row per month per
pair, so the window partitions are bounded by the number of months). Everything per month or per
(industry, month) uses aggregates or the distributed ranks of :mod:`storewatch.operators.ranking`.
The store-month table is checkpointed once: every table below is derived from it.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storewatch.constants import AGE_COLS, TYPE_COLS
from storewatch.operators.ranking import with_percent_ranks
from storewatch.session import cut_lineage, spread
from storewatch.sources.tables import Tables, small_side

# fixed fixture rules: segment -> age band suffix, in order; sex from customer key parity
SEGMENT_BANDS = [("AUTOMOBILE", "1020"), ("BUILDING", "30"), ("FURNITURE", "40"), ("HOUSEHOLD", "50"),
                 ("MACHINERY", "60")]
PRED_PRIMES = {"pred_xgb": 101, "pred_lgbm": 103, "pred_rf": 107, "pred_gb": 109, "pred_dl": 113}
BIN_EDGES = [(0.10, "10%이하"), (0.25, "10-25%"), (0.50, "25-50%"), (0.75, "50-75%"), (0.90, "75-90%")]
BIN_TOP = "90%초과"


def bin_label(pr) -> F.Column:
    expr = None
    for edge, label in BIN_EDGES:
        expr = F.when(pr <= edge, label) if expr is None else expr.when(pr <= edge, label)
    return F.when(pr.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(BIN_TOP))


def _share(num: str | F.Column, den: str = "lines") -> F.Column:
    num = F.col(num) if isinstance(num, str) else num
    return F.round(F.lit(100.0) * num / F.col(den), 6)


# "seg" travels as a whole number in the order of the names (2 i + 1: the i-th listed one, even: one that is not listed), "loc" likewise, so
# that their minima are those of the names while every aggregate of lines holds numbers only and is hashed, not sorted
_SEGMENTS = sorted(s for s, _ in SEGMENT_BANDS)
_LOC = {"FLP": 0, "RSD": 1, "WP": 2}


def _segment_code(seg: F.Column) -> F.Column:
    below = sum(((seg > s).cast("int") for s in _SEGMENTS), F.lit(0))
    return F.lit(2) * below + seg.isin(_SEGMENTS).cast("int")


#: Suppliers of which the columns needed here (three numbers each) are broadcast; beyond it they are joined by a shuffle of the lines.
_STORES = 500_000


def line_grain(t: Tables) -> DataFrame:
    """(store, month, customer) rows: counts and sums of the order lines behind them."""
    nation = small_side(t.nation.select("n_nationkey", "n_regionkey"), 10_000)
    li = t.lineitem.select(
        "l_orderkey", "l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month"),
        # revenue in exact 1e-4 units (cents x percent) so sums never depend on summation order
        (F.round(F.col("l_extendedprice") * 100).cast("long")
         * (F.lit(100) - F.round(F.col("l_discount") * 100).cast("long"))).alias("rev4"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_r"),
        (F.col("l_linestatus") == "F").cast("int").alias("is_f"))
    orders = t.orders.select("o_orderkey", "o_custkey")
    cust = (t.customer.select("c_custkey", "c_nationkey", _segment_code(F.col("c_mktsegment")).alias("seg"))
            .join(nation.withColumnRenamed("n_nationkey", "c_nationkey").withColumnRenamed("n_regionkey", "c_reg"),
                  "c_nationkey"))
    supp = (t.supplier.select("s_suppkey", "s_nationkey")
            .join(nation.withColumnRenamed("n_nationkey", "s_nationkey").withColumnRenamed("n_regionkey", "s_reg"),
                  "s_nationkey"))
    supp = small_side(supp, _STORES)
    rows = t.lineitem.count()   # from the files' footers
    lines = (spread(li, rows, "l_orderkey").join(orders, li.l_orderkey == orders.o_orderkey)
             .join(supp, F.col("l_suppkey") == F.col("s_suppkey")))
    lines = spread(lines, rows, "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    loc = (F.when(F.col("c_nationkey") == F.col("s_nationkey"), _LOC["RSD"])
           .when(F.col("c_reg") == F.col("s_reg"), _LOC["WP"]).otherwise(_LOC["FLP"]))
    return (lines.select(
        F.col("l_suppkey").alias("suppkey"), "month", F.col("o_custkey").alias("cust"), F.col("l_orderkey").alias("ok"),
        "rev4", "is_r", "is_f", "seg", loc.alias("loc"), F.col("s_nationkey").alias("nat"), F.col("s_reg").alias("reg"))
        .groupBy("suppkey", "month", "cust")
        .agg(F.count(F.lit(1)).alias("lines_n"), F.sum("is_r").alias("r_n"), F.sum("is_f").alias("f_n"),
             F.sum("rev4").alias("rev4"), F.countDistinct("ok").alias("orders_n"),
             F.min("seg").alias("seg"), F.min("loc").alias("loc"), F.min("nat").alias("nat"), F.min("reg").alias("reg"))
        .withColumn("sex", F.col("cust") % 2))


def store_month(t: Tables) -> DataFrame:
    """One row per (store, month) with the raw measures."""
    g = line_grain(t)
    first = Window.partitionBy("suppkey", "cust")
    g = g.withColumn("first_m", F.min("month").over(first))
    # what a row is counted under travels as one number: sex, segment, locality and whether the customer is new (1), returning (0) or undated (2)
    new = F.when(F.col("first_m") == F.col("month"), 1).when(F.col("first_m") < F.col("month"), 0).otherwise(2)
    sex = F.when(F.col("sex") == 0, 0).when(F.col("sex") == 1, 1).otherwise(2)
    cell = ((F.coalesce(F.col("seg"), F.lit(0)) * 3 + sex) * 3 + F.col("loc")) * 3 + new
    g = spread(g.select("suppkey", "month", "lines_n", "r_n", "f_n", "rev4", "orders_n", "nat", "reg", cell.cast("int").alias("cell")),
               t.lineitem.count(), "suppkey", "month", always=True)
    rest = F.floor(F.col("cell") / 3)
    g = g.select("*", (F.col("cell") % 3).alias("new"), (rest % 3).alias("loc"), (F.floor(rest / 3) % 3).alias("sex"), F.floor(rest / 9).alias("seg"))

    def lines_if(cond):
        return F.sum(F.when(cond, F.col("lines_n")).otherwise(F.lit(0)))

    seg_aggs = []
    for sex, tag in ((0, "MAL"), (1, "FME")):
        for seg, band in SEGMENT_BANDS:
            seg_aggs.append(lines_if((F.col("sex") == sex) & (F.col("seg") == 2 * _SEGMENTS.index(seg) + 1)).alias(f"_{tag}_{band}"))
    sm = (g.groupBy("suppkey", "month")
          .agg((F.sum("rev4") / F.lit(10000.0)).alias("sales"), F.sum("rev4").alias("rev4"), F.sum("orders_n").alias("txn"),
               F.count(F.lit(1)).alias("ncust"), F.sum("lines_n").alias("lines"), F.sum("r_n").alias("r_n"),
               F.sum("f_n").alias("f_n"), *seg_aggs,
               lines_if(F.col("new") == 1).alias("_new"), lines_if(F.col("new") == 0).alias("_reu"),
               lines_if(F.col("loc") == _LOC["RSD"]).alias("_rsd"), lines_if(F.col("loc") == _LOC["WP"]).alias("_wp"),
               lines_if(F.col("loc") == _LOC["FLP"]).alias("_flp"),
               F.min("nat").alias("nat"), F.min("reg").alias("reg")))
    return sm


@dataclass
class Panel:
    merchants: DataFrame   # ds1
    usage: DataFrame       # ds2
    customers: DataFrame   # ds3
    preds: DataFrame
    store_month: DataFrame

    def with_cancel(self, form: str) -> Panel:
        """The same tables with ``APV_CE_RAT`` as ``bin`` label (risk path) or ``number`` (label path)."""
        source = {"bin": "APV_CE_RAT", "number": _CANCEL_NUMBER}[form]
        cols = [F.col(source).alias("APV_CE_RAT") if c == "APV_CE_RAT" else F.col(c)
                for c in self.usage.columns if c != _CANCEL_NUMBER]
        return replace(self, usage=self.usage.select(*cols))


def _month_index(c) -> F.Column:
    return F.year(c) * 12 + F.month(c)


_CANCEL_NUMBER = "_APV_CE_RAT_number"


def build_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """ds1/ds2/ds3/preds in the reference's column layout; ``usage`` holds both forms of ``APV_CE_RAT`` (choose one
    with :meth:`Panel.with_cancel`)."""
    t = Tables(spark, sf_dir)
    sm = store_month(t)
    store = F.col("suppkey").cast("string")
    sm = cut_lineage(sm.withColumns({   # every branch below (8 rank specs, peer aggregates) reads this
        "aov": F.round(F.col("sales") / F.col("txn"), 6),
        "r_share": _share("r_n"),
        "f_share": _share("f_n"),
    }))
    stores = cut_lineage(sm.groupBy("suppkey").agg(F.min("nat").alias("nat"), F.min("reg").alias("reg"), F.min("month").alias("first_m"),
                                                   F.max("month").alias("last_m")))
    since = small_side(stores.select("suppkey", "first_m"), _STORES)
    global_last = stores.select(F.max("last_m")).scalar()
    by_month = ["month"]
    open_for = (sm.join(since, "suppkey").withColumn("ops_months", _month_index(F.col("month")) - _month_index(F.col("first_m")))
                .select("suppkey", "month", "nat", "reg", "sales", "txn", "ncust", "aov", "ops_months", "r_share", "f_share"))
    ranked = with_percent_ranks(open_for, ["suppkey", "month"], [
        ("pr_sales", by_month, "sales", False),
        ("pr_txn", by_month, "txn", False),
        ("pr_cust", by_month, "ncust", False),
        ("pr_aov", by_month, "aov", False),
        ("pr_ops", by_month, "ops_months", False),
        ("pr_r", by_month, "r_share", False),
        ("pr_ind_sales", ["nat", "month"], "sales", True),
        ("pr_area_sales", ["reg", "month"], "sales", True),
    ])
    ind = (sm.groupBy("nat", "month")
           .agg((F.lit(100.0) * F.sum("r_n") / F.sum("lines")).alias("ind_r"),
                (F.sum("rev4") / F.count(F.lit(1)) / F.lit(10000.0)).alias("ind_avg_sales"), F.avg("txn").alias("ind_avg_txn")))
    area = sm.groupBy("reg", "month").agg((F.lit(100.0) * F.sum("r_n") / F.sum("lines")).alias("area_r"))
    # at most nations (regions) x months rows each: the store-months are not shuffled for them
    full = (ranked.join(small_side(cut_lineage(ind)), ["nat", "month"], "left")
            .join(small_side(cut_lineage(area)), ["reg", "month"], "left"))

    ta_ym = F.date_format("month", "yyyyMM")
    usage = full.select(
        store.alias("ENCODED_MCT"), ta_ym.alias("TA_YM"),
        bin_label(F.col("pr_sales")).alias("RC_M1_SAA"),
        bin_label(F.col("pr_txn")).alias("RC_M1_TO_UE_CT"),
        bin_label(F.col("pr_cust")).alias("RC_M1_UE_CUS_CN"),
        bin_label(F.col("pr_aov")).alias("RC_M1_AV_NP_AT"),
        bin_label(F.col("pr_r")).alias("APV_CE_RAT"),
        bin_label(F.col("pr_ops")).alias("MCT_OPE_MS_CN"),
        F.col("f_share").alias("DLV_SAA_RAT"),
        F.round(F.lit(100.0) * F.col("sales") / F.col("ind_avg_sales"), 6).alias("M1_SME_RY_SAA_RAT"),
        F.round(F.lit(100.0) * F.col("txn") / F.col("ind_avg_txn"), 6).alias("M1_SME_RY_CNT_RAT"),
        F.round(F.lit(100.0) * F.col("pr_ind_sales"), 6).alias("M12_SME_RY_SAA_PCE_RT"),
        F.round(F.lit(100.0) * F.col("pr_area_sales"), 6).alias("M12_SME_BZN_SAA_PCE_RT"),
        F.round(F.col("ind_r"), 6).alias("M12_SME_RY_ME_MCT_RAT"),
        F.round(F.col("area_r"), 6).alias("M12_SME_BZN_ME_MCT_RAT"),
        F.col("r_share").alias(_CANCEL_NUMBER),
    )
    age = [_share(f"_{c.split('_')[1]}_{c.split('_')[2]}").alias(c) for c in AGE_COLS]
    customers = sm.select(
        store.alias("ENCODED_MCT"), ta_ym.alias("TA_YM"), *age,
        _share("_reu").alias("MCT_UE_CLN_REU_RAT"), _share("_new").alias("MCT_UE_CLN_NEW_RAT"),
        _share("_rsd").alias(TYPE_COLS[0]), _share("_wp").alias(TYPE_COLS[1]), _share("_flp").alias(TYPE_COLS[2]),
    )
    merchants = (stores
                 .select(store.alias("ENCODED_MCT"), F.col("nat").cast("string").alias("HPSN_MCT_ZCD_NM"),
                         F.col("reg").cast("string").alias("HPSN_MCT_BZN_CD_NM"),
                         F.when(F.col("last_m") < global_last, F.add_months("last_m", 1)).alias("MCT_ME_D")))
    h = F.col("suppkey") * 7919 + _month_index(F.col("month"))
    preds = (sm.where(h % 13 != 0)
             .select(store.alias("ENCODED_MCT"), F.col("month").alias("TA_YM"),
                     *[((h * p) % 1000 / F.lit(1000.0)).alias(name) for name, p in PRED_PRIMES.items()]))
    # the four derived tables play the role of the input files: materialise them once
    return Panel(cut_lineage(merchants), cut_lineage(usage), cut_lineage(customers), cut_lineage(preds), sm)
