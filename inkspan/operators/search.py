"""Ranked full-text search for many queries at once.

Scores are BM25 sums over a query's words. Postings hold each query word's contribution to each document, in blocks of
``BLOCK`` neighbouring ids with the largest contribution of each block. Documents that cannot enter a query's
top are left out before they are scored in full:

* A few documents with the largest contributions of the query's strongest words are scored first; the score of the
  k-th best of them is a floor for the top.
* Words in the order of their largest contribution are optional as long as all of them together stay below the floor:
  no document gets there by them alone. Only documents with another word are candidates.
* A candidate's contributions of those words, and the block's largest ones of the optional words, bound its score. The
  candidates with the largest bounds are scored and lift the floor; of the others only those whose bound reaches it get
  the rest of their score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import pieces_of, snippet, word_list
from inkspan.sources.staging import stage
from inkspan.sources.tables import dealt

# The usual BM25 constants.
K1, B = 1.2, 0.75
BLOCK = 16
SEED_WORDS = 4
DIGITS = 6  # scores are rounded to so many


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, token) without repeats. Staged, so that its real size decides whether it is broadcast."""
    words = F.explode(F.array_distinct(word_list(F.col("query"))))
    return stage(queries.select("query_id", words.alias("token")), "query-terms")


def query_postings(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(token, doc_id, block, part) of the query words: what each adds to a document's score. Staged.

    Only query words leave the pass over the texts; document lengths are counted in it too, without exploding them. Texts are
    dealt by document, so that words are counted where they are and a task holds those of a part of the texts.
    """
    length = F.regexp_count(F.col(text), F.lit(r"[\p{L}\p{M}\p{N}_]+"))
    measured = dealt(docs.select("doc_id", text), "doc_id").select("doc_id", length.alias("n_words"), F.col(text).alias("_text"))
    words = (
        measured.select("doc_id", "n_words", F.explode(pieces_of(F.col("_text"))).alias("_piece"))
        .select("doc_id", "n_words", F.explode(word_list(F.col("_piece"))).alias("token"))
        .join(terms.select("token"), "token", "left_semi")
    )
    tf = stage(words.groupBy("doc_id", "n_words", "token").agg(F.count(F.lit(1)).alias("tf")), "term-counts")
    corpus = docs.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean")).alias("s")
    ).scalar()
    seen = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = seen.withColumn("_s", corpus).select(
        "token", F.log(1 + (F.col("_s.n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )
    scored = tf.withColumn("_s", corpus)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("n_words") / F.col("_s.mean"))
    parts = scored.select("doc_id", "token", (F.col("tf") * (K1 + 1) / norm).alias("_w")).join(idf, "token")
    block = F.floor(F.col("doc_id") / BLOCK)
    return stage(parts.select("token", "doc_id", block.alias("block"), (F.col("_w") * F.col("idf")).alias("part")), "postings")


def _sum_parts(pairs: DataFrame, terms: DataFrame, postings: DataFrame, name: str) -> DataFrame:
    """(query_id, doc_id, ``name``): what the given words of each query add to the documents of ``pairs``."""
    asked = pairs.select("query_id", "doc_id").join(terms.select("query_id", "token"), "query_id")
    found = asked.join(postings.select("token", "doc_id", "part"), ["token", "doc_id"])
    return found.groupBy("query_id", "doc_id").agg(F.sum("part").alias(name))


def score_floors(terms: DataFrame, postings: DataFrame, top: int) -> DataFrame:
    """(query_id, floor): a score that at least ``top`` documents reach; queries without so many seeds are left out.

    ``terms`` has the largest contribution ``most`` of each word.
    """
    strong = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "token"))
    words = terms.withColumn("_place", strong).filter(F.col("_place") <= SEED_WORDS).select("query_id", "token")
    best = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("part"), "doc_id"))
    wanted = postings.join(words.select("token").distinct(), "token", "left_semi")
    leading = wanted.withColumn("_place", best).filter(F.col("_place") <= top).select("token", "doc_id")
    seeds = words.join(leading, "token").select("query_id", "doc_id").distinct()
    return _kth(_sum_parts(seeds, terms, postings, "score"), top)


def _kth(scored: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    kth = scored.withColumn("_place", place).filter(F.col("_place") == top)
    return kth.select("query_id", (F.col("score") - 2 * 10.0**-DIGITS).alias("floor"))  # rounding lifts no score so far


def candidates(terms: DataFrame, postings: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """(alive, optional): documents that may be in a query's top, as (query_id, doc_id, part), and the query's words
    that are not in ``part`` yet."""
    most = postings.groupBy("token").agg(F.max("part").alias("most"))
    weighed = stage(terms.join(most, "token"), "weighed-terms")
    floors = stage(score_floors(weighed, postings, top), "floors")
    upto = F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "token"))  # a query's words
    told = weighed.withColumn("_upto", upto).join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    told = stage(told.select("query_id", "token", (F.col("_upto") < F.col("floor")).alias("optional")), "told-terms")
    needed, optional = told.filter(~F.col("optional")), told.filter("optional")
    found = needed.join(postings, "token").groupBy("query_id", "doc_id", "block").agg(F.sum("part").alias("part"))
    blocks = postings.groupBy("token", "block").agg(F.max("part").alias("most"))
    rest = optional.join(blocks, "token").groupBy("query_id", "block").agg(F.sum("most").alias("rest"))
    bounded = found.join(rest, ["query_id", "block"], "left").join(floors, "query_id", "left")
    bound = (F.col("part") + F.coalesce("rest", F.lit(0.0))).alias("bound")
    bounded = bounded.select("query_id", "doc_id", "part", bound, F.coalesce("floor", F.lit(0.0)).alias("floor"))
    bounded = stage(bounded.filter("bound >= floor"), "bounds")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "doc_id"))
    leading = bounded.withColumn("_place", place).filter(F.col("_place") <= 2 * top).select("query_id", "doc_id")
    lifted = _kth(_sum_parts(leading, terms, postings, "score"), top).withColumnRenamed("floor", "lifted")
    alive = bounded.join(lifted, "query_id", "left").filter(F.col("bound") >= F.coalesce("lifted", F.lit(0.0)))
    return stage(alive.select("query_id", "doc_id", "part"), "candidates"), optional


def bm25_top(docs: DataFrame, queries: DataFrame, top: int, text: str = "text") -> DataFrame:
    """(query_id, doc_id, score) of all documents that may be among the ``top`` of a query."""
    terms = query_words(queries)
    postings = query_postings(docs, terms, text)
    alive, optional = candidates(terms, postings, top)
    more = _sum_parts(alive, optional, postings, "more")
    full = alive.join(more, ["query_id", "doc_id"], "left")
    return full.select("query_id", "doc_id", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score"))


def search_ranked(
    docs: DataFrame, queries: DataFrame, top: int = 10, text: str = "text", title: str = "name"
) -> DataFrame:
    """The best documents per query: query_id, place, doc_id, name, score, highlight.

    Ranking keeps at most ``top`` rows per query on each task before the shuffle (window group
    limit), and texts are joined only to the winners. Scores are rounded to six digits first, so
    equal documents rank by id.
    """
    scores = bm25_top(docs, queries, top, text).withColumn("score", F.round("score", DIGITS))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    best = scores.withColumn("place", place).filter(F.col("place") <= top)
    pattern = queries.select(
        "query_id",
        F.concat(
            F.lit(r"(?iU)(?<![\p{L}\p{M}\p{N}_])(?:"),
            F.array_join(F.array_distinct(word_list(F.col("query"))), "|"),
            F.lit(r")(?![\p{L}\p{M}\p{N}_])"),
        ).alias("_pattern"),
    )
    found = best.join(docs.select("doc_id", F.col(title).alias("name"), F.col(text).alias("_text")), "doc_id")
    return found.join(pattern, "query_id").select(
        "query_id", "place", "doc_id", "name", "score",
        snippet(F.col("_text"), F.col("_pattern"), 0, 30).alias("highlight"),
    )
