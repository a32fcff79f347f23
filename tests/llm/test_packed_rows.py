"""Packed rows follow the data, not the square of the partitions."""
from storewatch.llm import packed, substring


def test_rows_between_tasks_follow_the_text(spark, docs_of, monkeypatch):
    made, real = [], packed.regroup

    def counted(frame, kinds, parts):
        made.append((frame.count(), parts))
        return real(frame, kinds, parts)

    monkeypatch.setattr(packed, "regroup", counted)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = docs_of([(i, f"own{i} {passage} end{i}") for i in range(600)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        done = substring.remove_repeats(docs, min_words=13).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(r.repeats.n_removed == (60 if r.doc_id else 0) for r in done) and len(done) == 600
    cores = spark.sparkContext.defaultParallelism
    assert made and all(parts <= max(cores, 1) and rows <= 2 * cores * packed.doc_buckets(cores) for rows, parts in made)


def test_partitions_stay_the_session_s_for_large_texts(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert packed.partitions(spark) == n and packed.partitions(spark, 1 << 50) == n
