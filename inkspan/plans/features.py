"""Registered queries for features, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions.text import word_list
from inkspan.operators import features as op
from inkspan.operators.language import PROFILES
from inkspan.plans.fixtures import Corpus, with_ctes
from inkspan.sources.staging import stage

CUT = 50
MIN_DF = 0.01
TITLE_MIN_DF, TITLE_MAX_DF = 0.005, 0.5


def titled(c):
    """Documents with their first sentence as title."""
    return c.documents().withColumn("title", F.regexp_extract("text", r"^[^.\n]*", 0))


def tokenize_cut(spark, folder):
    c = Corpus(spark, folder)
    d = c.raw("documents")
    return d.select(
        "doc_id",
        op.tokenize_cut(F.col("text"), CUT).alias("first_words"),
        F.md5(op.tokenize_cut(F.col("text")).cast("binary")).alias("all_words_md5"),
    )


def stop_words(spark, folder):
    c = Corpus(spark, folder)
    words = word_list(F.col("text"))
    kept = op.without_stop_words(words, F.col("lang"), PROFILES)
    return c.raw("documents").select("doc_id", F.array_join(kept, " ").alias("kept"))


def ngrams(spark, folder):
    """Documents and occurrences per n-gram of one to three words, over all conversations."""
    c = Corpus(spark, folder)
    turns = c.raw("conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text"
    )
    counts = op.term_counts(turns, ngram_range=(1, 3))
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_total"))


def tfidf_text(spark, folder):
    c = Corpus(spark, folder)
    out = op.tfidf(c.raw("documents").select("doc_id", "lang", "text"), min_df=MIN_DF, stop_words=PROFILES)
    return out.withColumn("value", F.round("value", 6))


def tfidf_bigrams(spark, folder):
    """Words and word pairs of whole texts."""
    c = Corpus(spark, folder)
    out = op.tfidf(c.raw("documents").select("doc_id", "text"), min_df=MIN_DF, ngram_range=(1, 2))
    return out.withColumn("value", F.round("value", 6))


def tfidf_title(spark, folder):
    c = Corpus(spark, folder)
    out = op.tfidf(titled(c).select("doc_id", "title"), "title", TITLE_MIN_DF, TITLE_MAX_DF)
    return out.withColumn("value", F.round("value", 6))


def custom_columns():
    return {
        "extension": op.extension_code(F.col("ext")),
        "lines": F.size(F.split("text", "\n", -1)),
        "upper_share": F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.length("text"),
    }


def extension_feature(spark, folder):
    c = Corpus(spark, folder)
    return c.documents().select("doc_id", op.extension_code(F.col("ext")).alias("code"))


def custom_features(spark, folder):
    c = Corpus(spark, folder)
    return op.custom_features(c.documents(), custom_columns()).withColumn("value", F.round("value", 6))


def all_features(c, stop_words=PROFILES):
    """The three families. The small ones are staged, so they are made one after another and not all beside the words of the texts."""
    docs = titled(c)
    custom = stage(op.custom_features(docs, custom_columns()), "custom-features")
    title = stage(op.tfidf(docs.select("doc_id", "title"), "title", TITLE_MIN_DF, TITLE_MAX_DF), "title-features")
    return op.assemble_features(
        op.tfidf(docs.select("doc_id", "lang", "text"), min_df=MIN_DF, stop_words=stop_words), title, custom
    )


def _counting():
    """A user's vectorizer: letters and digits of a text, and its share of line ends."""
    def vectorize(texts):
        for text in texts:
            digits = sum(text.count(d) for d in "0123456789")
            yield {"digits": digits, "at_signs": text.count("@"), "line_share": text.count("\n") / max(1, len(text))}

    return vectorize


def user_vectorizer(spark, folder):
    c = Corpus(spark, folder)
    out = op.vectorized_features(c.raw("documents").select("doc_id", "text"), _counting)
    return out.withColumn("value", F.round("value", 6))


def assemble_features(spark, folder):
    out = all_features(Corpus(spark, folder))
    family = F.split_part("feature", F.lit(":"), F.lit(1))
    return out.groupBy("doc_id", family.alias("family")).agg(
        F.count(F.lit(1)).alias("n_features"), F.round(F.sum("value"), 4).alias("total")
    )


def fit_transform_split(spark, folder):
    """Vocabulary from four fifths of the documents, applied to the others."""
    c = Corpus(spark, folder)
    docs = c.raw("documents").select("doc_id", "lang", "text")
    train, rest = docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0")
    counts = stage(op.term_counts(train, stop_words=PROFILES), "term-counts")
    vocabulary = stage(op.fit_tfidf(counts, train, MIN_DF), "vocabulary")
    out = op.transform_tfidf(op.term_counts(rest, stop_words=PROFILES), vocabulary)
    return out.withColumn("value", F.round("value", 6))


def doc_vectors(spark, folder):
    c = Corpus(spark, folder)
    out = op.document_vectors(c.raw("documents"))
    return out.select("doc_id", F.size("vector").alias("n"), F.round(F.element_at("vector", 1), 6).alias("first"))


def chi2_select(spark, folder):
    c = Corpus(spark, folder)
    labelled = c.labelled()
    labels = labelled.select("doc_id", "label")
    counts = op.term_counts(labelled.select("doc_id", "text"))
    features = counts.select("doc_id", F.col("term").alias("feature"), F.col("tf").cast("double").alias("value"))
    scored = op.chi2_scores(features, labels).withColumn("score", F.round("score", 6))
    return op.select_k_best(scored, 100)


QUERIES = {
    "tokenize_cut": tokenize_cut,
    "stop_words": stop_words,
    "ngrams": ngrams,
    "tfidf_text": tfidf_text,
    "tfidf_bigrams": tfidf_bigrams,
    "tfidf_title": tfidf_title,
    "extension_feature": extension_feature,
    "custom_features": custom_features,
    "user_vectorizer": user_vectorizer,
    "assemble_features": assemble_features,
    "fit_transform_split": fit_transform_split,
    "doc_vectors": doc_vectors,
    "chi2_select": chi2_select,
}

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"
_STOP = ", ".join(f"('{lang}', '{w}')" for lang, ws in PROFILES.items() for w in ws)
_CODE = "CASE " + " ".join(
    "WHEN ext IN (%s) THEN %d" % (", ".join(f"'{e}'" for e in exts), i)
    for i, exts in enumerate(op.EXTENSION_GROUPS.values(), start=1)
) + " ELSE 0 END"


def _tfidf_ctes(prefix: str, tokens: str, docs: str, low: float, high: float, apply_to: str | None = None) -> dict:
    return {
        f"{prefix}_tf": ([], f"SELECT doc_id, term, count(*) AS tf FROM ({tokens}) GROUP BY ALL"),
        f"{prefix}_idf": ([f"{prefix}_tf"], f"""
            SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf
            FROM {prefix}_tf, (SELECT count(*) AS n FROM {docs})
            GROUP BY term, n HAVING count(*) >= {low} * n AND count(*) <= {high} * n"""),
        f"{prefix}_w": ([f"{prefix}_idf"], f"""
            SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS value
            FROM {apply_to or prefix + '_tf'} JOIN {prefix}_idf USING (term)"""),
    }


def _stopped(where: str) -> str:
    return f"""SELECT doc_id, term FROM (SELECT doc_id, lang, unnest({_WORDS.format('text')}) AS term
               FROM documents WHERE {where}) WHERE length(term) >= 2 AND (lang, term) NOT IN (VALUES {_STOP})"""


_TITLE = f"""SELECT doc_id, term FROM (SELECT doc_id,
    unnest({_WORDS.format("regexp_extract(text, '^[^.' || chr(10) || ']*')")}) AS term FROM documents)
    WHERE length(term) >= 2"""

_GRAM_WORDS = "list_filter({}, lambda w: length(w) >= 2)"
_BIGRAM = f"""SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term
    FROM (SELECT doc_id, {_GRAM_WORDS.format(_WORDS.format('text'))} AS w FROM documents)"""

FEATURE_CTES = {
    **_tfidf_ctes("text", _stopped("true"), "documents", MIN_DF, 1.0),
    **_tfidf_ctes("bi", _BIGRAM, "documents", MIN_DF, 1.0),
    **_tfidf_ctes("title", _TITLE, "documents", TITLE_MIN_DF, TITLE_MAX_DF),
    **_tfidf_ctes("train", _stopped("doc_id % 5 <> 0"), "documents WHERE doc_id % 5 <> 0", MIN_DF, 1.0, "rest_tf"),
    "rest_tf": ([], f"SELECT doc_id, term, count(*) AS tf FROM ({_stopped('doc_id % 5 = 0')}) GROUP BY ALL"),
    "custom": (["fx_documents"], f"""
        SELECT doc_id, 'extension' AS feature, ({_CODE})::DOUBLE AS value FROM fx_documents
        UNION ALL SELECT doc_id, 'lines', len(string_split(text, chr(10))) FROM fx_documents
        UNION ALL SELECT doc_id, 'upper_share', length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(text)
        FROM fx_documents"""),
}

ORACLE = {
    "tokenize_cut": f"""
        SELECT doc_id, array_to_string(w[1:{CUT}], ' ') AS first_words,
               md5(array_to_string(w, ' ')) AS all_words_md5
        FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)""",
    "stop_words": f"""
        SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS kept FROM documents LEFT JOIN (
          SELECT * FROM (SELECT doc_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
            FROM (SELECT doc_id, lang, {_WORDS.format('text')} AS ws FROM documents))
          WHERE (lang, w) NOT IN (VALUES {_STOP})) USING (doc_id) GROUP BY doc_id""",
    "ngrams": f"""
        SELECT term, count(DISTINCT id) AS n_docs, count(*) AS n_total FROM (
          SELECT id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
            || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS term
          FROM (SELECT (conv_id, turn) AS id, {_GRAM_WORDS.format(_WORDS.format('text'))} AS w FROM conversations))
        GROUP BY term""",
    "tfidf_text": with_ctes(["text_w"], "SELECT doc_id, term, round(value, 6) AS value FROM text_w", FEATURE_CTES),
    "tfidf_bigrams": with_ctes(["bi_w"], "SELECT doc_id, term, round(value, 6) AS value FROM bi_w", FEATURE_CTES),
    "tfidf_title": with_ctes(["title_w"], "SELECT doc_id, term, round(value, 6) AS value FROM title_w", FEATURE_CTES),
    "extension_feature": with_ctes(["fx_documents"], f"SELECT doc_id, ({_CODE})::INT AS code FROM fx_documents"),
    "user_vectorizer": """
        SELECT doc_id, feature, round(value, 6) AS value FROM (
          SELECT doc_id, 'digits' AS feature, len(regexp_extract_all(text, '[0-9]'))::DOUBLE AS value FROM documents
          UNION ALL SELECT doc_id, 'at_signs', len(regexp_extract_all(text, '@'))::DOUBLE FROM documents
          UNION ALL SELECT doc_id, 'line_share', len(regexp_extract_all(text, '\\n'))::DOUBLE / greatest(1, length(text)) FROM documents)
        WHERE value <> 0""",
    "custom_features": with_ctes(["custom"], "SELECT doc_id, feature, round(value, 6) AS value FROM custom", FEATURE_CTES),
    "assemble_features": with_ctes(["text_w", "title_w", "custom"], """
        SELECT doc_id, family, count(*) AS n_features, round(sum(value), 4) AS total FROM (
          SELECT doc_id, 'text' AS family, value FROM text_w UNION ALL SELECT doc_id, 'title', value FROM title_w
          UNION ALL SELECT doc_id, 'custom', value FROM custom) GROUP BY ALL""", FEATURE_CTES),
    "fit_transform_split": with_ctes(["rest_tf", "train_w"], """
        SELECT doc_id, term, round(value, 6) AS value FROM train_w""", FEATURE_CTES),
    "chi2_select": with_ctes(["fx_labelled"], f"""
        , terms AS (SELECT label, unnest({_WORDS.format('text')}) AS term FROM fx_labelled),
        obs AS (SELECT term, label, count(*) AS o FROM terms WHERE length(term) >= 2 GROUP BY ALL),
        classes AS (SELECT label, count(*) / (SELECT count(*) FROM fx_labelled) AS share FROM fx_labelled GROUP BY label),
        grid AS (SELECT term, label, share * t AS e FROM (SELECT term, sum(o) AS t FROM obs GROUP BY term), classes)
        SELECT term AS feature, round(sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e), 6) AS score
        FROM grid LEFT JOIN obs USING (term, label) GROUP BY term ORDER BY score DESC, feature LIMIT 100""").replace(
        ") \n        , terms", "), terms"),
}
