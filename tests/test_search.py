"""The best documents against scores of all documents, and how few are scored in full."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkspan.operators import search


def plain(docs, queries, top):
    counts = {i: Counter(re.findall(r"\w+", t.lower())) for i, t in docs}
    sizes = {i: sum(c.values()) for i, c in counts.items()}
    mean, df = sum(sizes.values()) / len(docs), Counter(w for c in counts.values() for w in c)
    out = set()
    for q, text in queries:
        words, scores = set(re.findall(r"\w+", text.lower())), []
        for i, c in counts.items():
            parts = [
                math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sizes[i] / mean))
                for w in words if w in c
            ]
            scores += [(-round(sum(parts), 6), i)] if parts else []
        out |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])}
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.choice([3, 40, 200])))) for k in range(600)]
    docs += [(1000 + k, docs[9][1]) for k in range(50)]  # ties
    queries = [(k, " ".join(rng.choices(words, k=rng.choice([1, 5, 20])))) for k in range(15)]
    queries += [(50, docs[9][1]), (51, "w0 w1 w2"), (52, "nowhere"), (53, "")]
    return docs, queries


@pytest.mark.parametrize("top", [1, 10, 1000])
def test_equal_to_scoring_all(spark, tables, top):
    docs, queries = tables
    frame = spark.createDataFrame([(i, t, f"n{i}") for i, t in docs], "doc_id long, text string, name string")
    found = search.search_ranked(frame, spark.createDataFrame(queries, "query_id long, query string"), top).collect()
    got = {(r.query_id, r.place, r.doc_id, round(r.score, 5)) for r in found}
    assert got == {(q, k, i, round(s, 5)) for q, k, i, s in plain(docs, queries, top)}


def test_few_of_the_pairs_that_share_a_word_are_scored(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    queries = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    terms = search.query_words(queries)
    postings = search.query_postings(docs, terms)
    sharing = terms.join(postings, "token").select("query_id", "doc_id").distinct().count()
    alive, _ = search.candidates(terms, postings, 10)
    assert 400 <= alive.count() < sharing / 4


def test_few_words_pass_the_filter_of_a_word_list(spark):
    """The words that meet the join of partial names, with broadcasts off."""
    from inkspan.functions.membership import listed_filter

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        listed = spark.range(500).selectExpr("concat('w', id) AS token")
        words = spark.range(50_000).selectExpr("concat('w', id) AS token")
        passed = words.filter(listed_filter(listed, "token")(F.col("token")))
        assert passed.join(listed, "token", "left_semi").count() == 500 and passed.count() < 500 + 50_000 / 8
        assert words.filter(listed_filter(listed.limit(0), "token")(F.col("token"))).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
