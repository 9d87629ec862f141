"""Registered queries for name and keyword search, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions import names as fn
from inkspan.functions.text import word_list
from inkspan.operators import names as op
from inkspan.plans.fixtures import Corpus, with_ctes
from inkspan.sources.staging import stage

MAX_MIDDLE = 1


def search_docs(c):
    return c.documents().select("doc_id", "company_id", "lang", "text", "name")


def common_names(c):
    """First word of every benchmark item that has at least four letters."""
    first = F.element_at(word_list(F.col("text")), 1)
    return c.raw("benchmark").select(first.alias("common_name")).filter("length(common_name) >= 4").distinct()


def _name_inputs(c):
    """Names with initials, periods and hyphens, made from people's and customers' names."""
    p = c.people().select(F.col("person_id").alias("id"), "name")
    k = c.raw("customer").select(
        (-F.col("c_custkey") - 1).alias("id"),
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("J. "), "c_name"))
        .when(F.col("c_custkey") % 4 == 1, F.concat("c_name", F.lit(" B "), "c_mktsegment", F.lit(" Smith")))
        .when(F.col("c_custkey") % 4 == 2, F.concat("c_mktsegment", F.lit(" A.B.")))
        .otherwise(F.concat("c_mktsegment", F.lit(" ... "), "c_name"))
        .alias("name"),
    )
    return p.unionByName(k)


def clean_name(spark, folder):
    c = Corpus(spark, folder)
    return _name_inputs(c).select("id", fn.clean_name(F.col("name")).alias("cleaned"))


def middle_names(spark, folder):
    c = Corpus(spark, folder)
    return _name_inputs(c).select(
        "id",
        fn.middle_name_count(F.col("name")).cast("bigint").alias("middle_names"),
        fn.without_middle_names(F.col("name")).alias("reduced"),
    )


def exact_name_match(spark, folder):
    c = Corpus(spark, folder)
    return op.exact_name_matches(search_docs(c), c.people(), MAX_MIDDLE)


def swapped_name_match(spark, folder):
    """Two moves allowed: last name first is found as well."""
    c = Corpus(spark, folder)
    return op.exact_name_matches(search_docs(c), c.people(), 2)


def partial_name_match(spark, folder):
    c = Corpus(spark, folder)
    return op.partial_name_matches(search_docs(c), c.people())


def keyword_match(spark, folder):
    c = Corpus(spark, folder)
    return op.keyword_matches(search_docs(c), c.keywords())


def language_filter(spark, folder):
    """Keyword hits per language; only own-language lists are tried."""
    c = Corpus(spark, folder)
    docs = search_docs(c)
    hits = op.keyword_matches(docs, c.keywords()).join(docs.select("doc_id", "lang"), "doc_id")
    return hits.groupBy("lang", "keyword").agg(F.count(F.lit(1)).alias("n_docs"))


def included_docs(spark, folder):
    c = Corpus(spark, folder)
    included = c.user_documents().filter("NOT private").join(
        c.documents().select("doc_id", "company_id"), "doc_id"
    )
    return op.included_docs(search_docs(c).select("doc_id", "company_id"), included)


def _positions(docs, people, keywords, exact=False, partial=False):
    """Tokens that any of the searches needs, from one pass over the texts."""
    terms = [op.keyword_terms(keywords)]
    terms += [op.exact_terms(people, MAX_MIDDLE)] if exact else []
    terms += [op.partial_terms(people)] if partial else []
    return op.search_positions(docs, terms)


def high_risk_exact(spark, folder):
    c = Corpus(spark, folder)
    docs, people, keywords = search_docs(c), c.people(), c.keywords()
    seen = _positions(docs, people, keywords, exact=True)
    found = stage(op.keyword_matches(docs, keywords, seen), "keywords")
    loud, _ = op.loud_and_quiet(seen, found)
    return op.high_risk_exact(op.exact_name_matches(docs, people, MAX_MIDDLE, loud), found, people)


def high_risk_partial(spark, folder):
    c = Corpus(spark, folder)
    docs, people, keywords = search_docs(c), c.people(), c.keywords()
    seen = _positions(docs, people, keywords, partial=True)
    found = stage(op.keyword_matches(docs, keywords, seen), "keywords")
    loud, _ = op.loud_and_quiet(seen, found)
    return op.high_risk_partial(op.match_ranges(docs, people, loud), found)


def match_range(spark, folder):
    c = Corpus(spark, folder)
    docs, people = search_docs(c), c.people()
    ranged = op.match_ranges(docs, people)
    return ranged.select("person_id", "doc_id", "start", "end", "range_ok")


def risk_hits(spark, folder):
    c = Corpus(spark, folder)
    docs, people, lists = search_docs(c), c.people(), c.keywords()
    seen = _positions(docs, people, lists, exact=True, partial=True)
    keywords = stage(op.keyword_matches(docs, lists, seen), "keywords")
    _, quiet = op.loud_and_quiet(seen, keywords)
    exact = op.low_risk(op.exact_name_matches(docs, people, MAX_MIDDLE, quiet), keywords, people)
    partial = op.low_risk(op.partial_name_matches(docs, people, quiet), keywords, people)
    return exact.withColumn("kind", F.lit("exact")).unionByName(partial.withColumn("kind", F.lit("partial")))


def common_name_hits(spark, folder):
    c = Corpus(spark, folder)
    docs = search_docs(c)
    hits = op.common_name_hits(
        op.common_name_matches(docs, common_names(c)), op.keyword_matches(docs, c.keywords())
    )
    return hits.withColumn("keyword", F.coalesce("keyword", F.lit("")))


def set_people(spark, folder):
    """Customers sent as lists replace the stored people of companies 0 and 1."""
    c = Corpus(spark, folder)
    relation = F.col("c_custkey") % 4
    empty = F.array().cast("array<string>")
    lists = c.raw("customer").filter("c_nationkey % 3 < 2").select(
        (F.col("c_nationkey") % 3).cast("bigint").alias("company_id"),
        *[F.when(relation == i, F.array("c_name")).otherwise(empty).alias(n) for i, n in enumerate(op.RELATIONS)],
    )
    return op.set_people(c.people(), lists)


QUERIES = {
    "clean_name": clean_name,
    "middle_names": middle_names,
    "exact_name_match": exact_name_match,
    "swapped_name_match": swapped_name_match,
    "partial_name_match": partial_name_match,
    "keyword_match": keyword_match,
    "language_filter": language_filter,
    "included_docs": included_docs,
    "high_risk_exact": high_risk_exact,
    "high_risk_partial": high_risk_partial,
    "match_range": match_range,
    "risk_hits": risk_hits,
    "common_name_hits": common_name_hits,
    "set_people": set_people,
}

NAME_CTES = {
    "name_inputs": (["fx_people"], """
        SELECT person_id AS id, name FROM fx_people UNION ALL
        SELECT -c_custkey - 1, CASE c_custkey % 4 WHEN 0 THEN 'J. ' || c_name
            WHEN 1 THEN c_name || ' B ' || c_mktsegment || ' Smith' WHEN 2 THEN c_mktsegment || ' A.B.'
            ELSE c_mktsegment || ' ... ' || c_name END FROM customer"""),
    # fixture names are two plain words, so a phrase is two tokens of one field
    "two_words": (["fx_people"], """
        SELECT person_id, company_id, name, relation, lower(split_part(name, ' ', 1)) AS a,
               lower(split_part(name, ' ', 2)) AS b FROM fx_people WHERE name <> ''"""),
    "exact_match": (["two_words", "fx_tokens"], """
        SELECT DISTINCT p.person_id, x.doc_id FROM two_words p
        JOIN fx_tokens x ON x.token = p.a AND x.company_id = p.company_id
        JOIN fx_tokens y ON y.token = p.b AND y.doc_id = x.doc_id AND y.field = x.field AND y.pos <> x.pos
        WHERE abs(y.pos - 1 - x.pos) <= 1"""),
    "swapped_match": (["two_words", "fx_tokens"], """
        SELECT DISTINCT p.person_id, x.doc_id FROM two_words p
        JOIN fx_tokens x ON x.token = p.a AND x.company_id = p.company_id
        JOIN fx_tokens y ON y.token = p.b AND y.doc_id = x.doc_id AND y.field = x.field AND y.pos <> x.pos
        WHERE abs(y.pos - 1 - x.pos) <= 2"""),
    "partial_match": (["two_words", "fx_tokens"], """
        SELECT DISTINCT p.person_id, x.doc_id FROM two_words p
        JOIN fx_tokens x ON x.company_id = p.company_id AND x.token IN (p.a, p.b)"""),
    "keyword_hits": (["fx_keywords", "fx_tokens"], """
        SELECT DISTINCT doc_id, keyword FROM fx_tokens x JOIN fx_keywords k
          ON x.lang = k.lang AND x.token = k.keyword WHERE field = 'text'"""),
    "first_seen": (["fx_tokens"], """
        SELECT doc_id, token, min((field = 'name')::INT * 100000000 + pos) AS at FROM fx_tokens GROUP BY ALL"""),
    "ranges": (["partial_match", "first_seen"], """
        SELECT person_id, doc_id, strpos(lower(name), part)::INT - 1 AS "start",
               strpos(lower(name), part)::INT - 1 + length(part)::INT AS "end" FROM (
          SELECT m.person_id, m.doc_id, p.name, arg_min(s.token, s.at) AS part
          FROM partial_match m JOIN two_words p USING (person_id)
          JOIN first_seen s ON s.doc_id = m.doc_id AND s.token IN (p.a, p.b) GROUP BY ALL)"""),
    "common_names": ([], """
        SELECT DISTINCT w AS common_name FROM (
          SELECT regexp_extract(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS w FROM benchmark) WHERE length(w) >= 4"""),
    "common_hits": (["common_names", "fx_tokens", "keyword_hits"], """
        SELECT doc_id, common_name, keyword, CASE WHEN keyword IS NULL THEN 'low' ELSE 'high' END AS risk
        FROM (SELECT DISTINCT doc_id, token AS common_name FROM fx_tokens
              WHERE token IN (SELECT common_name FROM common_names)) LEFT JOIN keyword_hits USING (doc_id)"""),
}


def _spelled(sql: str, back: bool = False) -> str:
    """Spell accented letters with ASCII letters and back: DuckDB's word boundary is ASCII only."""
    for i, char in enumerate("éèêëàâçñíóúüäößÉÈÊÇÑÍÓÜÄÖ"):
        code = "zq" + chr(97 + i) + "qz"
        sql = f"replace({sql}, '{code}', '{char}')" if back else f"replace({sql}, '{char}', '{code}')"
    return sql


_WHO = "person_id, p.name AS person_name, p.relation"

ORACLE = {
    "clean_name": with_ctes(["name_inputs"], f"""
        SELECT id, {_spelled("trim(regexp_replace(" + _spelled("name") + r", '(\b[A-Za-z]\.? ?\b)|\.', '', 'g'))", back=True)}
               AS cleaned FROM name_inputs""", NAME_CTES),
    "middle_names": with_ctes(["name_inputs"], r"""
        SELECT id, greatest(len(w) - 2, 0)::BIGINT AS middle_names,
               CASE WHEN len(w) > 1 THEN w[1] || ' ' || w[-1] ELSE name END AS reduced
        FROM (SELECT id, name, regexp_extract_all(name, '[^\s]+') AS w FROM name_inputs)""", NAME_CTES),
    "exact_name_match": with_ctes(["exact_match"], "SELECT * FROM exact_match", NAME_CTES),
    "swapped_name_match": with_ctes(["swapped_match"], "SELECT * FROM swapped_match", NAME_CTES),
    "partial_name_match": with_ctes(["partial_match"], "SELECT * FROM partial_match", NAME_CTES),
    "keyword_match": with_ctes(["keyword_hits"], "SELECT * FROM keyword_hits", NAME_CTES),
    "language_filter": with_ctes(["keyword_hits"], """
        SELECT lang, keyword, count(*) AS n_docs FROM keyword_hits JOIN documents USING (doc_id) GROUP BY ALL""", NAME_CTES),
    "included_docs": with_ctes(["fx_documents", "fx_user_documents"], """
        SELECT doc_id, company_id FROM fx_documents
        WHERE doc_id IN (SELECT doc_id FROM fx_user_documents WHERE NOT private)"""),
    "high_risk_exact": with_ctes(["exact_match", "keyword_hits"], f"""
        SELECT doc_id, {_WHO}, keyword FROM exact_match JOIN keyword_hits USING (doc_id)
        JOIN fx_people p USING (person_id)""", NAME_CTES),
    "high_risk_partial": with_ctes(["ranges", "keyword_hits"], f"""
        SELECT doc_id, {_WHO}, keyword, "start", "end" FROM ranges JOIN keyword_hits USING (doc_id)
        JOIN fx_people p USING (person_id)""", NAME_CTES),
    "match_range": with_ctes(["ranges"], """
        SELECT person_id, doc_id, "start", "end", "start" >= 0 AS range_ok FROM ranges""", NAME_CTES),
    "risk_hits": with_ctes(["exact_match", "partial_match", "keyword_hits"], f"""
        SELECT doc_id, {_WHO}, kind FROM (
          SELECT *, 'exact' AS kind FROM exact_match UNION ALL SELECT *, 'partial' FROM partial_match)
        JOIN fx_people p USING (person_id) WHERE doc_id NOT IN (SELECT doc_id FROM keyword_hits)""", NAME_CTES),
    "common_name_hits": with_ctes(["common_hits"], """
        SELECT doc_id, common_name, coalesce(keyword, '') AS keyword, risk FROM common_hits""", NAME_CTES),
    "set_people": with_ctes(["fx_people"], """
        SELECT company_id, relation, name FROM fx_people WHERE company_id = 2 UNION ALL
        SELECT (c_nationkey % 3)::BIGINT, (c_custkey % 4 + 1)::INT, c_name FROM customer WHERE c_nationkey % 3 < 2"""),
}
