"""The training-text pipeline: each stage reads what the one before has written.

Defined cases: null and empty texts pass every filter (they are not toxic, hold no test item and no
secret); among repeated rows of one id, those with equal text count as one document and one row stays.
All stages but the last return the columns of ``documents``, whatever they are, in their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import bpe, decontaminate, minhash, secrets, toxicity
from inkspan.llm.frames import fresh_name, key_or_least, stage, table

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below ``TOXIC_FROM``; learned from the labels outside the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("toxicity") < TOXIC_FROM).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    found = minhash.near_duplicates(docs, "doc_id", "text")
    doc, rows = fresh_name(docs, "_doc"), fresh_name(docs, "_rows")
    others = stage(found.filter(~F.col("kept")).select(key_or_least("doc_id").alias(doc)).distinct(), "duplicates")
    first = docs.withColumn(doc, key_or_least("doc_id")).join(others, doc, "left_anti")
    # Rows that repeat an id are few; only they are compared as whole texts.
    repeated = first.groupBy(doc).agg(F.count("*").alias(rows)).filter(F.col(rows) > 1).select(doc)
    repeated = stage(repeated, "repeated")
    once = first.join(repeated, doc, "left_semi").dropDuplicates([doc, "text"])
    return first.join(repeated, doc, "left_anti").select(docs.columns).union(once.select(docs.columns))


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edited ones included."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask; n_chars follows a changed text."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        length = F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        clean = clean.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids and hashes of the ids and of the bytes they decode to."""
    return bpe.round_trip(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_test_items),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

# The learned toxicity model has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
