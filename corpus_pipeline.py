"""From raw documents to packed training sequences: five stages, each one operator of ``storewatch.llm``.

A stage takes (spark, docs, sf_dir) and returns a frame; its rows are written as Parquet and reread as the
next stage's ``docs``.  All but the last return the columns of ``documents``.

Defined cases, in every stage: further columns are carried whatever their names and types; a null text counts as empty; an
empty table gives an empty result; rows without an id are documents of their own; what a stage does with empty and
repeated rows is in its docstring.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storewatch.llm import jaccard, packing, quality, source_mix, substring
from storewatch.session import cut_lineage, ship_package
from storewatch.sources.tables import read_table, small_side

QUALITY_THRESHOLD = 0.3
NEAR_WORDS, NEAR_SIMILARITY = 5, 80  # shingle length, Jaccard in hundredths
REPEAT_WORDS = 50
MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED = (5, 2, 1), 3, 17
SEQUENCE_TOKENS, VOCABULARY = 2048, "word_bpe_49k.json"

#: Trained and hash-defined stages have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return name


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score (conditional random field over lines) reaches the threshold; empty texts are scored like
    one empty line, repeated rows alike."""
    ship_package(spark)
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    out = _fresh(docs, "quality_of_text")
    scored = quality.score_quality(docs, model, threshold=QUALITY_THRESHOLD, out=out)
    return scored.filter(F.col(f"{out}.predicted") == 1).select(_all(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates.  Rows of one id and text count as one document (the first by their other
    columns stays); different texts that share an id are told apart by their text, like rows without an id; each row without a
    word stays, but for copies of its id and text."""
    ship_package(spark)
    key, own, shared, place = (_fresh(docs, n) for n in ("_key", "_own", "_shared", "_place"))
    text = F.xxhash64(F.col("text"))
    twice = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).filter("lo <> hi")
    twice = small_side(cut_lineage(twice.select("doc_id", F.lit(True).alias(shared))))
    named = docs.join(twice, "doc_id", "left").withColumn(own, F.when(F.col(shared).isNull(), F.col("doc_id")))
    named = named.withColumn(key, jaccard.row_key(own, "text")).drop(shared)
    groups = jaccard.similar_groups(named, id_col=own, n=NEAR_WORDS, num=NEAR_SIMILARITY, den=100)
    stay = groups.filter("row_key = group_key").select(F.col("row_key").alias(key)).distinct()
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy(key, "doc_id").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in other])) if other else F.lit(0))
    kept = named.join(stay, key, "left_semi").withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1)
    return kept.select(_all(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; those left without a word go, those that had none stay."""
    ship_package(spark)
    out = _fresh(docs, "repeats")
    cut = substring.remove_repeats(docs, min_words=REPEAT_WORDS, out=out)
    gone, words = F.col(f"{out}.n_removed"), F.col(f"{out}.n_words")
    left = cut.filter((gone == 0) | (gone < words))
    return left.withColumn("n_chars", F.when(gone > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(_all(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; repeated rows are documents of their own."""
    ship_package(spark)
    return source_mix.mix(docs, weights=MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids and place in the training sequences (``packing.sequences`` joins them)."""
    import public_tokenizers

    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), SEQUENCE_TOKENS, with_ids=True)


STAGES = [("quality classifier", good_quality), ("n-gram Jaccard join", one_of_each_group),
          ("substring dedup", without_repeats), ("mixing sources", mixed), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
