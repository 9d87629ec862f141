"""Registered queries for entity extraction, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions import national_id
from inkspan.functions.text import spans_table
from inkspan.operators import entities as op
from inkspan.plans.fixtures import Corpus, with_ctes


def find_national_ids(spark, folder):
    """Valid national ids with their offsets."""
    return op.national_id_mentions(Corpus(spark, folder).id_texts()).select(
        "doc_id", "entity", "validated", "start", "end", "occurrence"
    )


def validate_national_id(spark, folder):
    """All two-digit day, month and year combinations of orders, shifted to hit impossible days."""
    o = Corpus(spark, folder).raw("orders")
    number = F.concat(
        F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"),
        F.lpad((F.col("o_custkey") % 14).cast("string"), 2, "0"),
        F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"),
        F.when(F.col("o_orderkey") % 11 == 0, "xxxx").otherwise(
            F.lpad((F.col("o_orderkey") * 7 % 10000).cast("string"), 4, "0")
        ),
    )
    n = F.col("number")
    return o.select("o_orderkey", number.alias("number")).select(
        "o_orderkey",
        "number",
        national_id.has_real_date(n).alias("is_valid"),
        national_id.passes_mod11(n).alias("passes_mod11"),
    )


def _phone_texts(c):
    docs = c.raw("documents").select("doc_id", "text")
    # Danish numbers in several groupings from customer keys
    key = F.lpad((F.col("c_custkey") * 7919 % 80000000 + 20000000).cast("string"), 8, "0")
    grouped = F.when(F.col("c_custkey") % 3 == 0, key).when(
        F.col("c_custkey") % 3 == 1, F.regexp_replace(key, r"(..)(..)(..)(..)", "$1 $2 $3 $4")
    ).otherwise(F.concat(F.lit("+45 "), key))
    text = F.concat(F.lit("tlf "), grouped, F.lit(" eller nr. "), F.col("c_custkey").cast("string"), F.lit("-"), key)
    return docs.unionByName(
        c.raw("customer").select((-F.col("c_custkey") - 1).alias("doc_id"), text.alias("text"))
    )


def find_phone_numbers(spark, folder):
    return op.phone_mentions(_phone_texts(Corpus(spark, folder))).select("doc_id", "start", "end", "occurrence")


def entity_length_guard(spark, folder):
    """Sentence spans as candidate entities."""
    docs = Corpus(spark, folder).raw("documents")
    spans = spans_table(docs, ["doc_id"], r"[^.\n]+[.]?")
    return op.drop_long_spans(spans).select("doc_id", "start", "end")


def entity_length_dropped(spark, folder):
    """How many candidate spans were too long, per source."""
    docs = Corpus(spark, folder).raw("documents")
    spans = op.with_length_check(spans_table(docs, ["source"], r"[^.\n]+[.]?"))
    return spans.groupBy("source").agg(
        F.count_if(F.col("too_long")).alias("dropped"), F.count_if(~F.col("too_long")).alias("kept")
    )


def _dictionary(c):
    """A word pair, a word triple and the first long word of every benchmark item."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    b = c.raw("benchmark").select(words.alias("w"))
    pair = F.struct(F.array_join(F.slice("w", 1, 2), " ").alias("term"), F.lit("PAIR").alias("label"))
    triple = F.struct(F.array_join(F.slice("w", 2, 3), " ").alias("term"), F.lit("TRIPLE").alias("label"))
    single = F.struct(F.get(F.filter("w", lambda w: F.length(w) >= 7), F.lit(0)).alias("term"), F.lit("WORD").alias("label"))
    return b.select(F.inline(F.array(pair, triple, single)))


def dictionary_ner(spark, folder):
    c = Corpus(spark, folder)
    found = op.dictionary_mentions(c.raw("documents").select("doc_id", "text"), _dictionary(c))
    return found.select("doc_id", "entity", "start", "end", F.lower("occurrence").alias("occurrence"))


def mention_rows(spark, folder):
    """All mentions of order notes and documents; the text at the offsets equals the occurrence."""
    c = Corpus(spark, folder)
    texts = c.id_texts().select((F.col("doc_id") + 1000000000).alias("doc_id"), "text").unionByName(
        _phone_texts(c)
    )
    found = op.mentions(texts)
    return found.select("doc_id", "entity", "validated", "start", "end", "occurrence")


def fresh_national_id_docs(c):
    """Fresh documents whose order note holds an id that also passes the check digit."""
    found = op.find_national_ids(c.id_texts()).filter("is_valid AND passes_mod11")
    found = op.mention_rows(found, ["doc_id"], F.lit(op.NATIONAL_ID))
    return op.docs_with_entity(c.documents(), found, op.NATIONAL_ID)


def docs_with_entity(spark, folder):
    return fresh_national_id_docs(Corpus(spark, folder))


QUERIES = {
    "find_national_ids": find_national_ids,
    "validate_national_id": validate_national_id,
    "find_phone_numbers": find_phone_numbers,
    "entity_length_guard": entity_length_guard,
    "entity_length_dropped": entity_length_dropped,
    "dictionary_ner": dictionary_ner,
    "mention_rows": mention_rows,
    "docs_with_entity": docs_with_entity,
}


def _valid_sql(n: str) -> str:
    """Date test by letting DuckDB build the date."""
    return f"""CASE WHEN upper(substr({n}, 7, 4)) = 'XXXX' THEN
          try_strptime((CASE WHEN substr({n}, 5, 2) = '00' THEN '2000' ELSE '19' || substr({n}, 5, 2) END)
             || '-' || substr({n}, 3, 2) || '-' || substr({n}, 1, 2), '%Y-%m-%d') IS NOT NULL
        ELSE try_strptime((CASE WHEN substr({n}, 7, 1) BETWEEN '0' AND '3' THEN '19'
             WHEN substr({n}, 7, 1) IN ('4', '9') AND substr({n}, 5, 2) <= '36' THEN '20'
             WHEN substr({n}, 7, 1) IN ('4', '9') THEN '19'
             WHEN substr({n}, 5, 2) <= '57' THEN '20' ELSE '18' END) || substr({n}, 5, 2)
             || '-' || substr({n}, 3, 2) || '-' || substr({n}, 1, 2), '%Y-%m-%d') IS NOT NULL END"""


def _mod11_sql(n: str) -> str:
    terms = " + ".join(f"try_cast(substr({n}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(national_id.WEIGHTS))
    return f"coalesce(({terms}) % 11 = 0, false)"


# Candidates start at any character whose left neighbour is no word character; the match is then
# tested on a short window. This finds offsets without splitting on the pattern.
_EXTRA = {
    "id_chars": (["fx_id_text"], """
        SELECT doc_id, text, ch, lag(ch, 1, ' ') OVER (PARTITION BY doc_id ORDER BY i) AS left_ch, i FROM (
          SELECT doc_id, text, unnest(string_split(text, '')) AS ch,
                 generate_subscripts(string_split(text, ''), 1) AS i FROM fx_id_text)"""),
    "id_hits": (["id_chars"], """
        SELECT doc_id, (i - 1)::INT AS "start", occ AS occurrence, (i - 1 + length(occ))::INT AS "end",
               replace(replace(occ, '-', ''), ' ', '') AS number
        FROM (SELECT *, regexp_extract(substr(text, i, 16),
                '^([0-3][0-9]{5} ?-? ?([0-9]{4}|[xX]{4}))([^\\p{L}\\p{N}_]|$)', 1) AS occ
              FROM id_chars WHERE ch BETWEEN '0' AND '3' AND NOT regexp_matches(left_ch, '[\\p{L}\\p{N}_]'))
        WHERE occ <> ''"""),
    "phone_texts": ([], """
        SELECT doc_id, text FROM documents
        UNION ALL SELECT -c_custkey - 1, 'tlf ' || CASE c_custkey % 3 WHEN 0 THEN k
              WHEN 1 THEN substr(k, 1, 2) || ' ' || substr(k, 3, 2) || ' ' || substr(k, 5, 2) || ' ' || substr(k, 7, 2)
              ELSE '+45 ' || k END || ' eller nr. ' || c_custkey || '-' || k
        FROM (SELECT *, lpad((c_custkey * 7919 % 80000000 + 20000000)::VARCHAR, 8, '0') AS k FROM customer)"""),
    "phone_chars": (["phone_texts"], """
        SELECT doc_id, text, ch, left_ch, i FROM phone_texts JOIN (
          SELECT *, lag(ch, 1, ' ') OVER (PARTITION BY doc_id ORDER BY i) AS left_ch FROM (
            SELECT doc_id, unnest(chars) AS ch, generate_subscripts(chars, 1) AS i
            FROM (SELECT doc_id, string_split(text, '') AS chars FROM phone_texts))) USING (doc_id)
        WHERE ch IN ('+', '2', '3', '4', '5', '6', '7', '8', '9')
              AND NOT regexp_matches(left_ch, '[\\p{L}\\p{N}_+.-]')"""),
    "phone_candidates": (["phone_chars"], """
        SELECT doc_id, i - 1 AS s, occ, i - 1 + length(occ) AS e FROM (
          SELECT *, regexp_extract(substr(text, i, 48), '^(\\+[1-9][0-9]{0,2}([ .-]?\\(?[0-9]{1,4}\\)?){2,5}'
             || '|[2-9][0-9]( ?[0-9]{2}){3})([^\\p{L}\\p{N}_]|$)', 1) AS occ FROM phone_chars)
        WHERE occ <> ''"""),
    "phone_hits": (["phone_candidates"], """
        SELECT doc_id, s::INT AS "start", e::INT AS "end", occ AS occurrence FROM phone_candidates c
        WHERE NOT EXISTS (SELECT 1 FROM phone_candidates b WHERE b.doc_id = c.doc_id AND b.s < c.s AND b.e > c.s)
          AND length(regexp_replace(occ, '[^0-9]', '', 'g')) BETWEEN 8 AND 15"""),
    "cpr_docs": (["id_hits", "fx_documents"], f"""
        SELECT doc_id FROM fx_documents WHERE is_fresh AND doc_id IN (
            SELECT doc_id FROM id_hits WHERE {_valid_sql('number')} AND {_mod11_sql('number')})"""),
    "sentences": ([], """
        SELECT doc_id, source, s - length(piece) AS s, s AS e, piece FROM (
          SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY no) AS s FROM (
            SELECT doc_id, source, unnest(p) AS piece, generate_subscripts(p, 1) AS no FROM (
              SELECT doc_id, source, regexp_extract_all(text, '[^.\\n]+[.]?|[.\\n]') AS p FROM documents)))
        WHERE piece NOT IN ('.', chr(10))"""),
}

ORACLE = {
    "find_national_ids": with_ctes(["id_hits"], f"""
        SELECT doc_id, 'CPR_NUMBER' AS entity, false AS validated, "start", "end", occurrence
        FROM id_hits WHERE {_valid_sql('number')}""", _EXTRA),
    "validate_national_id": f"""
        SELECT o_orderkey, number, {_valid_sql('number')} AS is_valid, {_mod11_sql('number')} AS passes_mod11
        FROM (SELECT o_orderkey, lpad((o_orderkey % 33)::VARCHAR, 2, '0') || lpad((o_custkey % 14)::VARCHAR, 2, '0')
               || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || CASE WHEN o_orderkey % 11 = 0 THEN 'xxxx'
               ELSE lpad((o_orderkey * 7 % 10000)::VARCHAR, 4, '0') END AS number FROM orders)""",
    "find_phone_numbers": with_ctes(["phone_hits"], 'SELECT doc_id, "start", "end", occurrence FROM phone_hits', _EXTRA),
    "entity_length_guard": with_ctes(["sentences"], """
        SELECT doc_id, s::INT AS "start", e::INT AS "end" FROM sentences WHERE e - s <= 150""", _EXTRA),
    "entity_length_dropped": with_ctes(["sentences"], """
        SELECT source, count(*) FILTER (e - s > 150) AS dropped, count(*) FILTER (e - s <= 150) AS kept
        FROM sentences GROUP BY source""", _EXTRA),
    "dictionary_ner": with_ctes(["dict", "runs"], """
        SELECT DISTINCT a.doc_id, label AS entity, a.s::INT AS "start", c.e::INT AS "end",
               lower(substr(d.text, (a.s + 1)::BIGINT, (c.e - a.s)::BIGINT)) AS occurrence
        FROM dict t JOIN runs a ON a.token = t.w[1]
        JOIN runs c ON c.doc_id = a.doc_id AND c.pos = a.pos + len(t.w) - 1 AND c.token = t.w[-1]
        LEFT JOIN runs b ON len(t.w) = 3 AND b.doc_id = a.doc_id AND b.pos = a.pos + 1
        JOIN documents d ON d.doc_id = a.doc_id
        WHERE len(t.w) < 3 OR b.token = t.w[2]""", {
        "dict": ([], """
            SELECT DISTINCT w, label FROM (
              SELECT unnest([{'w': w[1:2], 'label': 'PAIR'}, {'w': w[2:4], 'label': 'TRIPLE'},
                             {'w': list_filter(w, lambda x: length(x) >= 7)[1:1], 'label': 'WORD'}], recursive := true)
              FROM (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS w FROM benchmark)) WHERE len(w) > 0"""),
        "runs": ([], """
            SELECT doc_id, token, e - length(token) AS s, e, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS pos
            FROM (SELECT *, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY no) AS e FROM (
                    SELECT doc_id, unnest(p) AS token, generate_subscripts(p, 1) AS no FROM (
                      SELECT doc_id, regexp_extract_all(lower(text),
                             '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_]+') AS p FROM documents)))
            WHERE regexp_matches(token, '^[\\p{L}\\p{M}\\p{N}_]')"""),
    }),
    "mention_rows": with_ctes(["id_hits", "phone_hits"], f"""
        SELECT doc_id + 1000000000 AS doc_id, 'CPR_NUMBER' AS entity, false AS validated, "start", "end", occurrence
        FROM id_hits WHERE {_valid_sql('number')}
        UNION ALL SELECT doc_id, 'PHONE_NUMBER', false, "start", "end", occurrence FROM phone_hits""", _EXTRA),
    "docs_with_entity": with_ctes(["cpr_docs"], "SELECT doc_id FROM cpr_docs", _EXTRA),
}
