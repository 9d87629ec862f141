"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.llm import (
    bpe,
    collocations,
    decontaminate,
    idfile,
    licenses,
    metric_join,
    minhash,
    personal,
    ranked,
    repeats,
    secrets,
    toxicity,
    warc,
)
from inkspan.llm.frames import table

QUERIES, ORACLE = {}, {}


def op1_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"),
        "n_sentences",
        F.size("offending").cast("long").alias("n_offending"),
    )


QUERIES["op1_toxicity"] = op1_toxicity


def op9_bpe(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.round_trip(docs).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES["op9_bpe"] = op9_bpe


def op8_secrets(spark, folder):
    found = secrets.detect(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["depth"] == 0)
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda s: s["depth"] > 0)).cast("long").alias("n_hidden"),
    )


QUERIES["op8_secrets"] = op8_secrets


def op2_decontaminate(spark, folder):
    found = decontaminate.links(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "distance", "budget", "n_words", "start", "end"
    )


QUERIES["op2_decontaminate"] = op2_decontaminate


def op10_minhash(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"), shingle=2, threshold=0.8)


QUERIES["op10_minhash"] = op10_minhash
ORACLE["op10_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS shingle
  FROM w WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other
), c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op5_repeats(spark, folder):
    kept = repeats.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES["op5_repeats"] = op5_repeats
ORACLE["op5_repeats"] = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS p, unnest(list_transform(range(1, len(ws) - 18),
    lambda i: md5(array_to_string(ws[i:i + 19], ' ')))) AS h
  FROM t WHERE len(ws) >= 20
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM windows
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM ranked WHERE k > 1
), words AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM t
), kept AS (
  SELECT w.doc_id, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.p) AS text
  FROM words w ANTI JOIN covered c ON c.doc_id = w.doc_id AND c.p = w.p GROUP BY w.doc_id
)
SELECT t.doc_id, len(t.ws)::BIGINT AS n_words, (len(t.ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""


def op7_metric_join(spark, folder):
    return metric_join.near_vectors(table(spark, folder, "embeddings"))


QUERIES["op7_metric_join"] = op7_metric_join
ORACLE["op7_metric_join"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op3_licenses(spark, folder):
    found = licenses.detect(table(spark, folder, "documents").select("doc_id", "text"))
    base, more = F.col("base.label"), F.col("notices.label")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, more)).alias("labels"),
        "score",
        F.size(F.filter("notices", lambda n: n["edits"] > 0)).cast("long").alias("n_misspelt"),
    )


QUERIES["op3_licenses"] = op3_licenses


def op6_personal(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = personal.detect(docs, personal.fit(docs))
    base = F.filter("personal", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in personal.KINDS],
        F.sha2(personal.span_text(base), 256).alias("base_sha256"),
        personal.span_text(F.col("personal")).alias("spans"),
        F.size(F.filter("personal", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


QUERIES["op6_personal"] = op6_personal


def op4_warc(spark, folder):
    pages = table(spark, folder, "pages")
    captures = warc.write(pages, warc.archive_folder(spark))
    records = warc.lookup(pages, warc.build_index(captures))
    return records.select(
        warc.plain_id("capture").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        warc.plain_id("refers_to").alias("refers_to"),
    )


QUERIES["op4_warc"] = op4_warc
ORACLE["op4_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""


def op11_idfile(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    manifest = idfile.write(docs, idfile.archive_folder(spark))
    back = idfile.read(manifest, with_ids=False)
    return back.select(idfile.plain_key().alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES["op11_idfile"] = op11_idfile


def op13_collocations(spark, folder):
    return collocations.collocations(collocations.frequent_phrases(table(spark, folder, "documents")))


QUERIES["op13_collocations"] = op13_collocations
ORACLE["op13_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws
  FROM documents
), grams AS (
  SELECT lang, 1 AS size, unnest(ws) AS phrase FROM p
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM p WHERE len(ws) >= 2
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
  FROM p WHERE len(ws) >= 3
), f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size >= 2 AND f >= 10),
cuts AS (
  SELECT c.*, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:size], ' ') AS rest
  FROM cand c, (VALUES (1), (2)) t(k) WHERE k < size
), scored AS (
  SELECT c.lang, c.size, c.phrase, c.a, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f), k) AS cut
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first AND x.size = k
  JOIN f y ON y.lang = c.lang AND y.phrase = c.rest AND y.size = c.size - k
), inside AS (
  SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a FROM cand WHERE size = 3
), kept AS (
  SELECT s.* FROM scored s WHERE cut = 1 AND NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.a >= 50 * s.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""


def op12_ranked(spark, folder):
    found = ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        ranked.plain_id("item").alias("item_id"), "rank", ranked.plain_id("doc").alias("doc_id"), "score"
    )


QUERIES["op12_ranked"] = op12_ranked
ORACLE["op12_ranked"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), weighted AS (
  SELECT item_id, term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w
  FROM asked JOIN df USING (term), totals
), scored AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM weighted JOIN tf USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ordered WHERE rank <= 10
"""
