"""Similar documents (our definition): a complete set-similarity join over word shingles.

Two texts are similar when the Jaccard similarity of their sets of shingles (runs of three words) reaches the threshold;
documents are of one class when a chain of similar texts joins them. Exact copies are reduced to one text first.

The join is a prefix filter. Shingles are put in order of rarity over the whole corpus. Two sets of the wanted
similarity share one of the rarest ``n - ceil(t * n) + 1`` shingles of each, so only these are indexed; a shingle of one text
only is counted but joins nothing. Pairs meet by a shingle and by the size of their sets (sizes differ by a factor of
``1 / t`` at most), and a pair that shares a shingle at places that leave too little to have in common is not looked at.

Not all pairs of an indexed shingle are made: its texts are compared with the smallest of them first. Shingles whose texts
are in one class by then are settled; in the others, texts of different classes are compared. So a family of very many
near copies costs one comparison for each of them and shingle, while no pair between classes is left out.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.membership import listed_filter
from inkspan.functions.text import grams_of, word_runs
from inkspan.operators.components import classes
from inkspan.sources.staging import stage
from inkspan.sources.tables import dealt

SHINGLE_WORDS = 3
THRESHOLD = 0.5
ROWS_AT_ONCE = 1_000_000  # shingles of texts that one task counts or puts in order, about


def distinct_texts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep_id) for all documents, and the representatives with their texts.

    Copies are found by hash; the smallest id stands for all of them. The aggregate combines on
    the map side and carries no texts. The texts come dealt by document, so their shingles are made distinct where they are.
    """
    keyed = docs.select("doc_id", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min("doc_id").alias("rep_id"))
    members = keyed.join(first, "_key").select("doc_id", "rep_id")
    # not a semi join, which Spark would move below the dealing and shuffle the texts for on its own
    texts = dealt(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")), "doc_id").join(
        first.select(F.col("rep_id").alias("doc_id")).distinct(), "doc_id"
    )
    return members, texts


def shingle_rows(texts: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, shingle) without repeats, shingles as 64-bit hashes. A text with fewer words is one shingle.

    Texts are read piece by piece, so no array holds a long text.
    """
    runs = word_runs(texts, ["doc_id"], words)
    # The last piece of so short a text has all its words.
    short = F.col("is_last") & (F.size("words") < words)
    grams = F.when(short, F.array(F.array_join("words", " "))).otherwise(grams_of(F.col("words"), words, F.col("lead")))
    return runs.select("doc_id", F.explode(grams).alias("_gram")).select(
        "doc_id", F.xxhash64("_gram").alias("shingle")
    ).distinct()


def least_overlap(n: Column, m: Column, threshold: float) -> Column:
    """How many shingles sets of these sizes have to share."""
    return F.ceil(F.round(threshold / (1 + threshold) * (n + m), 9))


def prefix_index(sets: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(shared, index) of the sets, from one staged table.

    shared: doc_id, n (size of the set), shingle, for shingles of several texts. index: doc_id, n, shingle and place (1-based,
    in order of rarity) of the shingles in the prefix.
    """
    parts = max(1, ceil(sets.count() / ROWS_AT_ONCE))
    by_shingle = sets.filter("doc_id IS NOT NULL AND shingle IS NOT NULL").repartition(parts, "shingle")
    # the filter and counting doc_id keep this input identical to the one joined below, so it is shuffled once
    seen = by_shingle.groupBy("shingle").agg(F.count("doc_id").alias("df"))
    sizes = sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    several = by_shingle.join(seen.filter("df > 1"), "shingle").repartition(parts, "doc_id").join(sizes, "doc_id")
    by_doc = Window.partitionBy("doc_id")  # a set is that of one text
    alone = F.col("n") - F.count(F.lit(1)).over(by_doc)
    place = alone + F.row_number().over(by_doc.orderBy("df", "shingle"))
    placed = stage(several.withColumn("place", place).select("doc_id", "n", "shingle", "place"), "shared-shingles")
    length = F.col("n") - F.ceil(F.round(threshold * F.col("n"), 9)) + 1
    return placed.drop("place"), placed.filter(F.col("place") <= length)


def _may_reach(threshold: float) -> Column:
    """Whether two index rows (n, place and m, other_place) of one shingle leave enough to have in common.

    True for the rarest shingle a similar pair shares, which is in both prefixes.
    """
    n, m = F.col("n"), F.col("m")
    rest = F.least(n - F.col("place"), m - F.col("other_place")) + 1
    return (F.least(n, m) >= F.round(threshold * F.greatest(n, m), 9)) & (rest >= least_overlap(n, m, threshold))


def _verified(pairs: DataFrame, shared: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs (a, b) that reach the threshold, counted over their shared shingles."""
    pairs = stage(pairs, "pairs")
    # Most texts are in no pair: their shingles end in the task that reads them.
    left, right = (shared.filter(listed_filter(pairs.select(x).distinct(), x)(F.col("doc_id"))) for x in ("a", "b"))
    left = left.select(F.col("doc_id").alias("a"), "n", "shingle")
    right = right.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), "shingle")
    both = pairs.join(left, "a").join(right, ["b", "shingle"]).groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("both"))
    return both.select("a", "b", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("jaccard")).filter(
        F.col("jaccard") >= threshold
    )


def similar_links(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, jaccard), a > b: verified links between different texts that join all texts of each class. Staged."""
    shared, index = prefix_index(stage(shingle_rows(texts), "shingles"), threshold)
    heads = index.groupBy("shingle").agg(F.min(F.struct("doc_id", "n", "place")).alias("h"))
    first = (
        index.join(heads, "shingle")
        .select(F.col("doc_id").alias("a"), "n", "place", F.col("h.doc_id").alias("b"), F.col("h.n").alias("m"), F.col("h.place").alias("other_place"))
        .filter(F.col("a") != F.col("b"))
        .filter(_may_reach(threshold))
        .select("a", "b")
        .distinct()
    )
    found = stage(_verified(first, shared, threshold), "similar")
    named = classes(found).withColumnRenamed("node", "doc_id")
    placed = index.join(named, "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))
    # Shingles whose texts are of one class have nothing left to tell.
    open_ = placed.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high")
    rows = stage(placed.join(open_.select("shingle"), "shingle", "left_semi"), "open-shingles")
    # Sizes a factor of 1 / t apart at most are in the same or the next step of that factor.
    step = F.floor(F.round(F.log("n") / F.log(F.lit(1 / threshold)), 9)) if threshold < 1 else F.col("n")
    left = rows.withColumn("step", step).select(F.col("doc_id").alias("x"), "n", "place", "class", "shingle", "step")
    right = rows.withColumn("step", F.explode(F.array(step - 1, step, step + 1))).select(
        F.col("doc_id").alias("y"), F.col("n").alias("m"), F.col("place").alias("other_place"), F.col("class").alias("other"), "shingle", "step"
    )
    crossed = (
        left.join(right, ["shingle", "step"])
        .filter(F.col("class") < F.col("other"))
        .filter(_may_reach(threshold))
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        .distinct()
    )
    return stage(found.union(_verified(crossed, shared, threshold)), "similar")


def similar_documents(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, rep_id, is_copy, class_id): one row per document.

    ``rep_id`` is the first document with the same text, ``class_id`` the first one that similar texts lead to, any number
    of steps away. A document without a similar one is its own class. A null text is an empty one.
    """
    members, texts = distinct_texts(docs, text)
    named = classes(similar_links(texts, threshold)).select(F.col("node").alias("rep_id"), "class")
    return members.join(named, "rep_id", "left").select(
        "doc_id", "rep_id", (F.col("doc_id") != F.col("rep_id")).alias("is_copy"), F.coalesce("class", "rep_id").alias("class_id")
    )


def similar_sets(similar: DataFrame) -> DataFrame:
    """(class_id, n_docs, n_texts) of the classes with several documents."""
    return similar.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(~F.col("is_copy")).alias("n_texts")
    ).filter("n_docs > 1")
