"""Words are counted where their document is, in parts of bounded size."""

import pytest
from pyspark.sql import functions as F

from inkspan.functions import text
from inkspan.operators import features, linear
from inkspan.plans import features as plans
from inkspan.plans.fixtures import Corpus
from inkspan.sources import tables

FILE = "/root/testdata/sf0.001/documents.parquet"


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("- Exchange")


def test_parts_follow_the_files(spark, monkeypatch, tmp_path):
    folder = f"{tmp_path}/a b"
    spark.read.parquet(FILE).repartition(3).write.parquet(folder)
    assert tables.text_parts(spark.read.parquet(folder)) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "PART_BYTES", 1 << 12)
    size = sum(f.stat().st_size for f in (tmp_path / "a b").glob("*.parquet"))
    found = tables.dealt(spark.read.parquet(folder), "doc_id")
    assert found.rdd.getNumPartitions() == -(-size // (1 << 12)) > 8 and found.count() == spark.read.parquet(FILE).count()


@pytest.mark.parametrize("make", [features.term_counts, lambda d: features.term_counts(d, ngram_range=(1, 2))])
def test_words_are_not_shuffled(spark, make):
    docs = spark.read.parquet(FILE).select("doc_id", "text")
    assert _exchanges(make(docs)) == 1


def test_words_of_vectors_are_not_shuffled(spark):
    docs = spark.read.parquet(FILE).select("doc_id", "text")
    assert _exchanges(features.token_counts(docs)) <= 2


def test_rare_terms_share_buckets(spark, monkeypatch):
    """One bucket for all terms, or many: the vocabulary is the same."""
    rows = [(d, t, 1) for d in range(40) for t in ("all", f"half{d % 2}", f"own{d}")] + [(None, "null", 1)]
    counts, docs = spark.createDataFrame(rows, "doc_id long, term string, tf long"), spark.range(40)
    for buckets in (1, 1 << 20):
        monkeypatch.setattr(features, "BUCKETS", buckets)
        assert {(r.term, r.df) for r in features.fit_tfidf(counts, docs, 0.5, 0.9).collect()} == {("half0", 20), ("half1", 20)}
        assert features.fit_tfidf(counts, docs, 0.0).count() == 44


def test_terms_and_features_of_documents_are_sorted_in_parts_that_follow_the_input(spark, monkeypatch, tmp_path):
    """With the session's partitions a task's terms would grow with the input."""
    rows = [(d, f"t{k}", k + 1) for d in range(200) for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, term string, tf long").repartition(4).write.parquet(f"{tmp_path}/counts")
    counts = spark.read.parquet(f"{tmp_path}/counts")
    vocabulary = spark.createDataFrame([(f"t{k}", 1.0) for k in range(5)], "term string, idf double")
    plain = sorted(tuple(r) for r in features.transform_tfidf(counts, vocabulary).collect())
    monkeypatch.setattr(tables, "PART_BYTES", 256)
    parts = tables.text_parts(counts)
    valued = features.transform_tfidf(counts, vocabulary)
    assert parts > 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) and valued.rdd.getNumPartitions() == parts
    assert sorted(tuple(r) for r in valued.collect()) == plain and len(plain) == 1000
    names = spark.createDataFrame([(f"t{k}", k, 2.0) for k in range(5)], "feature string, no int, scale double")
    found = counts.select("doc_id", F.col("term").alias("feature"), F.col("tf").cast("double").alias("value"))
    docs = spark.range(201).select(F.col("id").alias("doc_id"), F.lit(0).alias("label_no"), F.lit(1).alias("fold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for more than some MB
    try:
        packed = linear.pack_documents(docs, found, names)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(packed.inputFiles()) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(tuple(r.at), tuple(r["values"])) for r in packed.filter("doc_id < 200").collect()} == {((0, 1, 2, 3, 4), (0.5, 1.0, 1.5, 2.0, 2.5))}
    assert packed.count() == 201 and packed.filter("size(at) = 0").count() == 1


def test_words_without_a_lead_are_made_once(spark):
    """Single words need no last words of the piece before, so no piece is split into words a second time."""
    docs = spark.createDataFrame([(1, "ab cd ef gh ij"), (2, ""), (3, None)], "doc_id long, text string")
    made = []

    def words(piece, before):
        made.append(piece)
        return text.word_list(piece)

    runs = text.word_runs(docs, ["doc_id"], 0, words=words, size=4).collect()
    assert len(made) == 1
    assert sorted((r.doc_id, *r.words) for r in runs if r.words) == [(1, "ab", "cd"), (1, "ef", "gh"), (1, "ij")]
    assert {r.lead for r in runs} == {0}


def test_small_families_are_made_before_the_words_of_texts(spark, tmp_path):
    """One shuffle is left beside the union of the families: that of the words of the texts."""
    rows = [(d, f"Title{d % 3}. some words\nof text {d}", "en", "web", 30) for d in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.all_features(Corpus(spark, str(tmp_path)))
    assert _exchanges(found) == 1
    families = {r[0]: r[1] for r in found.groupBy(F.split_part("feature", F.lit(":"), F.lit(1))).count().collect()}
    assert families["custom"] == 120 and families["title"] >= 40 and families["text"] >= 40
