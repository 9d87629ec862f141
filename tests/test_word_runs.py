"""Words piece by piece, with the last words of the pieces before."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkspan.functions import text as T
from inkspan.operators import features


def plain(text, n):
    words = re.findall(r"\w+", (text or "").lower())
    return Counter(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    long = " ".join(rng.choice("ab cd Efg h ü9".split()) for _ in range(150))
    # Pieces without a word, and words longer than a piece, stand between others.
    return ["", None, "a", "a b", "!!!" * 30, long, "x" * 50 + " yy " + "!" * 70 + " zz a b", "one two three", "! " * 40 + "q r"]


@pytest.mark.parametrize("size", [7, 20, 4096])
@pytest.mark.parametrize("n", [1, 2, 4])
def test_grams_over_piece_borders(spark, texts, size, n):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = T.word_runs(docs, ["doc_id"], n - 1, size=size)
    assert runs.filter("size(words) - lead > %d" % (size + 60)).count() == 0
    rows = runs.select("doc_id", F.explode(T.grams_of(F.col("words"), n, F.col("lead"))).alias("gram")).collect()
    assert Counter((r.doc_id, r.gram) for r in rows) == Counter(
        {(i, g): c for i, t in enumerate(texts) for g, c in plain(t, n).items()}
    )


def test_a_cut_counts_words_of_the_whole_text(spark, monkeypatch):
    words = [f"w{k % 11}" for k in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = {r.term: r.tf for r in features.term_counts(docs, ngram_range=(1, 2), cut=2000).collect()}
    want = plain(" ".join(words[:2000]), 1) + plain(" ".join(words[:2000]), 2)
    assert got == dict(want)


def test_no_array_holds_a_long_text(spark):
    """A text of 50 MB: its n-grams are right, and the longest array of words is that of a piece."""
    docs = spark.createDataFrame([(1, "lorem ipsum dolor sit amet " * 1_900_000)], "doc_id long, text string")
    runs = T.word_runs(docs, ["doc_id"], 2)
    pairs = runs.select(F.size("words").alias("n"), F.explode(T.grams_of(F.col("words"), 3, F.col("lead"))).alias("g"))
    row = pairs.agg(F.max("n").alias("n"), F.count("g").alias("all"), F.count_if(F.col("g") == "amet lorem ipsum").alias("over")).first()
    assert row["n"] < 2_000 and row["all"] == 5 * 1_900_000 - 2 and row["over"] == 1_899_999
