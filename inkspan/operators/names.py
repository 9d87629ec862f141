"""Searching people's names and risk keywords in documents.

Documents carry doc_id, company_id, lang, text, name. People carry person_id, company_id, name,
relation; person rows are not de-duplicated, so person_id travels through every step.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.membership import listed_filter
from inkspan.functions import names as fn
from inkspan.functions.text import token_bag, word_list
from inkspan.operators.phrases import (
    only_words,
    phrase_matches,
    phrase_occurrences,
    phrase_terms,
    vocabulary_positions,
)
from inkspan.sources.staging import stage


PARTS = 1 << 20  # more than the words of a name
PEOPLE_AT_ONCE = 200_000  # rows of people that all tasks are sent together
PAIRS_AT_ONCE = 4_000_000  # pairs of a person and a document that one task decides on, about
MOST_PARTS = 20_000  # that documents are dealt into


def _least_parts(spark) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def document_parts(docs: DataFrame, people: DataFrame) -> int:
    """How many parts documents are dealt into, so that a task has about ``PAIRS_AT_ONCE`` pairs whatever the tables' sizes are.

    Hits grow with people times documents: with parts that grow with the documents alone, a task's hits outgrow its memory.
    """
    pairs = docs.count() * people.count()
    return max(_least_parts(docs.sparkSession), min(MOST_PARTS, ceil(pairs / PAIRS_AT_ONCE)))


def by_document(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt by document into ``parts``, else into four times the session's shuffle partitions.

    What is joined and grouped by document afterwards stays where it is, so the rows of people in documents, which grow with
    both, are never shuffled.
    """
    return df.repartition(parts or _least_parts(df.sparkSession), "doc_id")


def meet_people(rows: DataFrame, people: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``people``; the rows stay in their partitions, people come to them.

    People are sent in parts of about ``PEOPLE_AT_ONCE`` rows, so a task holds no more of them, however many there are.
    """
    listed = stage(people, "people")
    parts = max(1, ceil(listed.count() / PEOPLE_AT_ONCE))
    part = F.pmod(F.xxhash64(*on), F.lit(parts))
    out = None
    for k in range(parts):
        met = rows.join(F.broadcast(listed.filter(part == k)), on)
        out = met if out is None else out.unionByName(met)
    return out


def included_docs(docs: DataFrame, included: DataFrame) -> DataFrame:
    """Documents on their company's list of searched ids."""
    return docs.join(included.select("company_id", "doc_id"), ["company_id", "doc_id"], "left_semi")


def name_phrases(people: DataFrame, max_middle_names: int) -> DataFrame:
    """How each person is searched: the phrase and its slop.

    With few middle names, first and last name are searched and may have that many words between
    them; otherwise the full name must occur word for word.
    """
    few = fn.middle_name_count(F.col("name")) <= max_middle_names
    return people.withColumns(
        {
            "phrase": F.when(few, fn.without_middle_names(F.col("name"))).otherwise(F.col("name")),
            "slop": F.when(few, max_middle_names).otherwise(0),
        }
    )


def _searches(people: DataFrame, max_middle_names: int) -> DataFrame:
    """Distinct (person_id, company_id, slop, phrase); phrases of the same words are the same."""
    phrases = name_phrases(people, max_middle_names).withColumn("phrase", F.array_join(word_list(F.col("phrase")), " "))
    return phrases.select("person_id", "company_id", "slop", "phrase").distinct()


def exact_terms(people: DataFrame, max_middle_names: int = 1) -> DataFrame:
    """Words of all different phrases of people: (company_id, slop, phrase, n, i, token)."""
    keys = ["company_id", "slop", "phrase"]
    return phrase_terms(_searches(people, max_middle_names).select(*keys).distinct(), "phrase", keys)


def _parts(name: Column) -> Column:
    """Different words of the cleaned name."""
    return F.array_distinct(word_list(fn.clean_name(name)))


def partial_terms(people: DataFrame) -> DataFrame:
    """(person_id, company_id, token) of cleaned names; names that clean to nothing have none."""
    return people.select("person_id", "company_id", F.explode(_parts(F.col("name"))).alias("token"))


def keyword_terms(keywords: DataFrame) -> DataFrame:
    return phrase_terms(keywords.distinct(), "keyword", ["lang", "keyword"])


def search_positions(docs: DataFrame, vocabularies: list[DataFrame]) -> DataFrame:
    """One staged table of token positions for several searches, from one pass over the texts."""
    tokens = vocabularies[0].select("token")
    for more in vocabularies[1:]:
        tokens = tokens.unionByName(more.select("token"))
    return vocabulary_positions(docs, tokens, ["doc_id", "company_id", "lang"], ["text", "name"])


def loud_and_quiet(positions: DataFrame, keyword_hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The positions of documents with a keyword and those of the others, from one staged table."""
    loud = keyword_hits.select("doc_id", F.lit(True).alias("loud")).distinct()
    marked = positions.join(loud, "doc_id", "left").withColumn("loud", F.coalesce("loud", F.lit(False)))
    marked = stage(marked, "marked-positions")
    return marked.filter("loud").drop("loud"), marked.filter("NOT loud").drop("loud")


def exact_name_matches(
    docs: DataFrame, people: DataFrame, max_middle_names: int = 1, positions: DataFrame | None = None, parts: int | None = None
) -> DataFrame:
    """Distinct (person_id, doc_id): the person's phrase occurs in the text or in the title.

    ``positions`` may hold positions shared with other searches. Searches whose hits are united take the same ``parts``.
    """
    searches = _searches(people, max_middle_names)
    terms = stage(exact_terms(people, max_middle_names), "exact-terms")
    if positions is None:
        positions = vocabulary_positions(
            docs, terms.select("company_id", "token"), ["doc_id", "company_id"], ["text", "name"]
        )
    keys, scope = ["company_id", "slop", "phrase"], ["company_id"]
    found = phrase_matches(positions, terms.filter("slop = 0"), keys, scope, 0)
    if max_middle_names > 0:
        loose = phrase_matches(positions, terms.filter("slop > 0"), keys, scope, max_middle_names)
        found = found.unionByName(loose)
    return meet_people(by_document(found, parts), searches, keys).select("person_id", "doc_id").distinct()


def _words_of(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Words of text and title, distinct inside each piece before anything is shuffled."""
    long = docs.select(*keys, F.explode(F.array("text", "name")).alias("text")).filter("text IS NOT NULL")
    return token_bag(long, keys)


def partial_name_matches(
    docs: DataFrame, people: DataFrame, positions: DataFrame | None = None, parts: int | None = None
) -> DataFrame:
    """Distinct (person_id, doc_id): any word of the cleaned name occurs in text or title."""
    wanted = stage(partial_terms(people).distinct(), "partial-terms")
    keys = ["doc_id", "company_id"]
    if positions is None:
        # Most words are no part of a name and end here, in the stage of the scan, whatever the join is.
        words = _words_of(docs, keys).filter(listed_filter(wanted, "token")(F.col("token")))
    else:
        words = positions.select(*keys, "token")
    words = by_document(words, parts).distinct()
    return meet_people(words, wanted, ["company_id", "token"]).select("person_id", "doc_id").distinct()


def keyword_matches(
    docs: DataFrame, keywords: DataFrame, positions: DataFrame | None = None
) -> DataFrame:
    """Distinct (doc_id, keyword): keywords of the document's own language found in its text.

    The language is part of the join key, so all languages are searched in one pass and a document
    in a language without a list is never searched.
    """
    terms = keyword_terms(keywords)
    if positions is None:
        positions = vocabulary_positions(docs, terms.select("lang", "token"), ["doc_id", "lang"], ["text"])
    else:
        positions = only_words(positions, terms, ["lang"])
    in_text = positions.filter("field = 'text'")
    found = phrase_occurrences(in_text, terms, ["lang", "keyword"], ["lang"])
    return found.select("doc_id", "keyword").distinct()


def high_risk_exact(matches: DataFrame, keyword_hits: DataFrame, people: DataFrame) -> DataFrame:
    """One row per person row, document and matched keyword."""
    who = people.select("person_id", F.col("name").alias("person_name"), "relation")
    met = matches.join(keyword_hits.hint("shuffle_hash"), "doc_id")
    return meet_people(met, who, ["person_id"]).select("doc_id", "person_id", "person_name", "keyword", "relation")


def match_ranges(
    docs: DataFrame, people: DataFrame, positions: DataFrame | None = None, parts: int | None = None
) -> DataFrame:
    """Partial matches with the place, in the person's name, of the part that occurs first in the document.

    First is by position in the text, then in the title: an aggregate over token positions, so texts are
    read for the tokenization only. ``range_ok`` is false when the part cannot be placed in the
    original name; such rows are kept apart by the caller instead of failing the job.
    """
    names = people.select("company_id", "name").distinct()
    words = names.select("company_id", "name", F.posexplode(_parts(F.col("name"))).alias("_no", "token"))
    wanted = stage(words, "partial-terms")
    if positions is None:
        positions = vocabulary_positions(
            docs, wanted.select("company_id", "token"), ["doc_id", "company_id"], ["text", "name"]
        )
    # places of texts, then of titles, as one number, and below it the number of the part
    place = F.when(F.col("field") == "text", F.lit(0)).otherwise(F.lit(1 << 31)) + F.col("pos")
    words = by_document(positions.select("doc_id", "company_id", "token", place.alias("_at")), parts)
    words = words.groupBy("doc_id", "company_id", "token").agg(F.min("_at").alias("_at"))
    met = meet_people(words, wanted, ["company_id", "token"]).select(
        "doc_id", "company_id", "name", (F.col("_at") * PARTS + F.col("_no")).alias("_first")
    )
    first = met.groupBy("doc_id", "company_id", "name").agg((F.min("_first") % PARTS).alias("_no"))
    spots = F.transform(_parts(F.col("name")), lambda p: F.struct(fn.part_start(p, F.col("name")).cast("int").alias("start"), F.length(p).alias("length")))
    who = people.select("person_id", "company_id", "name", "relation", spots.alias("_spots"))
    spot = F.get("_spots", F.col("_no").cast("int"))
    placed = meet_people(first, who, ["company_id", "name"]).select(
        "person_id", "doc_id", F.col("name").alias("person_name"), "relation", spot["start"].alias("start"),
        (spot["start"] + spot["length"]).cast("int").alias("end"),
    )
    return placed.withColumn("range_ok", F.col("start") >= 0)


def high_risk_partial(ranged: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """One row per person row, document and keyword, with the range of the matched part."""
    return (
        ranged.filter("range_ok")
        .join(keyword_hits.hint("shuffle_hash"), "doc_id")
        .select("doc_id", "person_id", "person_name", "keyword", "relation", "start", "end")
    )


def range_failures(ranged: DataFrame) -> DataFrame:
    return ranged.filter("NOT range_ok")


def low_risk(matches: DataFrame, keyword_hits: DataFrame, people: DataFrame) -> DataFrame:
    """Name matches in documents without any risk keyword (our definition)."""
    who = people.select("person_id", F.col("name").alias("person_name"), "relation")
    quiet = matches.join(keyword_hits.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti")
    return meet_people(quiet, who, ["person_id"]).select("doc_id", "person_id", "person_name", "relation")


def common_name_matches(
    docs: DataFrame, common_names: DataFrame, positions: DataFrame | None = None
) -> DataFrame:
    """Distinct (doc_id, common_name) from a list of common first names (our definition)."""
    wanted = stage(common_names.select(F.lower("common_name").alias("token")).distinct(), "common-names")
    words = _words_of(docs, ["doc_id"]) if positions is None else only_words(positions, wanted, []).select("doc_id", "token")
    return words.join(wanted, "token").select("doc_id", F.col("token").alias("common_name")).distinct()


def common_name_hits(matches: DataFrame, keyword_hits: DataFrame, parts: int | None = None) -> DataFrame:
    """Common-name matches per keyword, with a null keyword and low risk where there is none."""
    return by_document(matches, parts).join(keyword_hits.hint("shuffle_hash"), "doc_id", "left").select(
        "doc_id",
        "common_name",
        "keyword",
        F.when(F.col("keyword").isNull(), "low").otherwise("high").alias("risk"),
    )


RELATIONS = ["current_employees", "former_employees", "current_customers", "former_customers"]


def people_from_lists(lists: DataFrame) -> DataFrame:
    """Person rows from rows that hold four name lists; relation is 1 to 4 in list order.

    A company's lists may arrive spread over several rows, so no row has to hold them all.
    """
    entries = F.array(
        *[F.struct(F.lit(i + 1).alias("relation"), F.col(c).alias("names")) for i, c in enumerate(RELATIONS)]
    )
    return lists.select("company_id", F.inline(entries)).select(
        "company_id", "relation", F.explode("names").alias("name")
    )


def set_people(stored: DataFrame, lists: DataFrame) -> DataFrame:
    """Replace the whole people list of every company that sent lists, even empty ones."""
    kept = stored.join(lists.select("company_id"), "company_id", "left_anti")
    columns = ["company_id", "relation", "name"]
    return kept.select(*columns).unionByName(people_from_lists(lists).select(*columns))
