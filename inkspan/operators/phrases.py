"""Finding many phrases in many texts with equi-joins on tokens.

A phrase is looked up by its rarest token, so a phrase that contains a very common word does not
touch that word's occurrences in documents that lack the rest of the phrase.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.membership import listed_filter
from inkspan.functions.text import text_pieces, word_list
from inkspan.sources.staging import stage


def phrase_terms(phrases: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per phrase word: the kept columns, i (0-based), token, n (words in the phrase)."""
    words = phrases.select(*keep, word_list(F.col(text)).alias("_words")).filter(F.size("_words") > 0)
    return words.select(*keep, F.size("_words").alias("n"), F.posexplode("_words").alias("i", "token"))


def field_positions(docs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Token positions of several text columns in one scan: keys, field, token, pos, piece_no, at."""
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("_text")) for f in fields])
    long = docs.select(*keys, F.inline(texts)).filter(F.col("_text").isNotNull())
    pieces = text_pieces(long, [*keys, "field"], "_text")
    words = pieces.select(
        *keys, "field", "piece_no", "token_base", F.posexplode(word_list(F.col("piece"))).alias("at", "token")
    )
    return words.select(
        *keys, "field", "token", (F.col("token_base") + F.col("at")).alias("pos"), "piece_no", "at"
    )


def vocabulary_positions(
    docs: DataFrame, vocabulary: DataFrame, keys: list[str], fields: list[str]
) -> DataFrame:
    """Positions of the vocabulary's tokens as a staged table; it is read several times below.

    ``vocabulary`` has a token column and possibly some of ``keys``. It is staged first, so its
    real size is known when the join with all tokens is planned: Spark broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and sorts and merges above, and only in the latter
    case are the tokens of the corpus shuffled.
    """
    wanted = stage(vocabulary.distinct(), "vocabulary")
    return stage(field_positions(docs, keys, fields).join(wanted, wanted.columns, "left_semi"), "positions")


def only_words(positions: DataFrame, terms: DataFrame, scope: list[str]) -> DataFrame:
    """Positions shared by several searches, thinned in the scan to the words of ``terms``, and to few others.

    A search shuffles positions once for each of its joins: without this, every search shuffles the words of all of them.
    """
    word = F.concat_ws(" ", *scope, "token")
    listed = stage(terms.select(word.alias("_word")).distinct(), "words")
    return positions.filter(listed_filter(listed, "_word")(word))


def _anchors(positions: DataFrame, terms: DataFrame, phrase: list[str], scope: list[str]) -> DataFrame:
    """The rarest word of every phrase; phrases with a word that occurs nowhere are left out."""
    seen = positions.groupBy(*scope, "token").agg(F.count(F.lit(1)).alias("_seen"))
    counted = terms.join(seen, [*scope, "token"], "left")
    return (
        counted.groupBy(*phrase)
        .agg(
            F.min(F.struct(F.coalesce("_seen", F.lit(0)).alias("seen"), "i", "token")).alias("_rarest"),
            F.first("n").alias("n"),
            *[F.first(s).alias(s) for s in scope if s not in phrase],
        )
        .filter(F.col("_rarest.seen") > 0)
        .select(*phrase, *[s for s in scope if s not in phrase], "n", F.col("_rarest.i").alias("i"),
                F.col("_rarest.token").alias("token"))
    )


def phrase_occurrences(
    positions: DataFrame, terms: DataFrame, phrase: list[str], scope: list[str]
) -> DataFrame:
    """Exact phrase occurrences: phrase, doc_id, field, first_pos, n, and where its ends lie.

    The rarest word fixes where every other word would have to stand, so the others are probed by
    an equi-join on (document, field, token, position).
    """
    anchors = _anchors(positions, terms, phrase, scope)
    where = F.struct("piece_no", "at")
    found = anchors.join(
        positions.select(*scope, "token", "doc_id", "field", "pos", where.alias("spot")), [*scope, "token"]
    ).withColumn("first_pos", F.col("pos") - F.col("i"))
    shape = [*phrase, "doc_id", "field", "first_pos", "n"]
    single = found.filter("n = 1").select(
        *shape, F.col("spot").alias("first_spot"), F.col("spot").alias("last_spot")
    )
    probes = (
        found.filter("n > 1")
        .select(*shape)
        .join(terms.select(*phrase, "i", "token"), phrase)
        .withColumn("pos", F.col("first_pos") + F.col("i"))
    )
    met = probes.join(
        positions.select("doc_id", "field", "token", "pos", where.alias("spot")),
        ["doc_id", "field", "token", "pos"],
    )
    several = (
        met.groupBy(*shape)
        .agg(
            F.count(F.lit(1)).alias("_met"),
            F.min_by("spot", "i").alias("first_spot"),
            F.max_by("spot", "i").alias("last_spot"),
        )
        .filter("_met = n")
        .drop("_met")
    )
    return single.unionByName(several)


def phrase_matches(
    positions: DataFrame, terms: DataFrame, phrase: list[str], scope: list[str], slop: int
) -> DataFrame:
    """Distinct (phrase, doc_id) with the phrase inside one field, with at most ``slop`` moves.

    Slop is the published sloppy-phrase rule: positions minus word indexes may spread over at most
    ``slop``; two or more moves therefore also accept swapped neighbours.
    """
    if slop == 0:
        return phrase_occurrences(only_words(positions, terms, scope), terms, phrase, scope).select(*phrase, "doc_id").distinct()
    pairs = _near_pairs(positions, terms.filter("n = 2"), phrase, scope, slop)
    terms = terms.filter("n <> 2")
    positions = only_words(positions, terms, scope)
    anchors = _anchors(positions, terms, phrase, scope)
    found = anchors.join(positions.select(*scope, "token", "doc_id", "field", "pos"), [*scope, "token"])
    single = found.filter("n = 1").select(*phrase, "doc_id")
    candidates = found.filter("n > 2").select(*phrase, "doc_id", "field", "n").distinct()
    placed = (
        candidates
        .join(terms.select(*phrase, "i", "token"), phrase)
        .join(positions.select("doc_id", "field", "token", "pos"), ["doc_id", "field", "token"])
        .withColumn("adj", F.col("pos") - F.col("i"))
    )
    # one phrase in one field of one document per window: bounded by the document
    near = (
        Window.partitionBy(*phrase, "doc_id", "field").orderBy("adj").rangeBetween(Window.currentRow, slop)
    )
    several = (
        placed.withColumns(
            {"_words": F.size(F.collect_set("i").over(near)), "_spots": F.size(F.collect_set("pos").over(near))}
        )
        .filter("_words = n AND _spots >= n")
        .select(*phrase, "doc_id")
    )
    return single.unionByName(pairs).unionByName(several).distinct()


def _near_pairs(
    positions: DataFrame, terms: DataFrame, phrase: list[str], scope: list[str], slop: int
) -> DataFrame:
    """Two-word phrases: the pairs of words that stand near enough in the texts, met with the phrases.

    A text has few such pairs for each of its words, however many phrases there are; most are no phrase and end in
    the task that makes them.
    """
    keys = list(dict.fromkeys([*scope, *phrase]))
    second = terms.filter("i = 1").select(*phrase, F.col("token").alias("_second"))
    wanted = terms.filter("i = 0").select(*keys, F.col("token").alias("_first")).join(second, phrase).distinct()
    listed = stage(wanted.withColumn("_pair", F.concat_ws(" ", *scope, "_first", "_second")), "word-pairs")
    words = positions.join(terms.select(*scope, "token").distinct(), [*scope, "token"], "left_semi")
    # dealt before the window doubles the columns
    words = words.select(*scope, "doc_id", "field", "pos", "token").repartition("doc_id")
    # the words of one field within reach of each of its words
    near = Window.partitionBy(*scope, "doc_id", "field").orderBy("pos").rangeBetween(1 - slop, 1 + slop)
    reached = words.select(
        *scope, "doc_id", F.col("token").alias("_first"), "pos",
        F.collect_list(F.struct(F.col("pos").alias("_at"), F.col("token").alias("_second"))).over(near).alias("_near"),
    )
    pairs = reached.select(*scope, "doc_id", "_first", "pos", F.inline("_near")).filter("_at <> pos")
    kept = pairs.filter(listed_filter(listed, "_pair")(F.concat_ws(" ", *scope, "_first", "_second")))
    return kept.join(listed, [*scope, "_first", "_second"]).select(*phrase, "doc_id")
