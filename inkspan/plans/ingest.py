"""Registered queries for ingest, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions.dates import parse_mail_date
from inkspan.functions.html import DROPPED, html_text, html_title
from inkspan.operators import ingest as op
from inkspan.operators.language import PROFILES, detect_language
from inkspan.plans.fixtures import Corpus, with_ctes
from inkspan.sources.fetch import PART_BYTES, fetch
from inkspan.sources.files import scan_files as list_files
from inkspan.sources.snapshots import SnapshotTable
from inkspan.sources.staging import new_path
from inkspan.sources.strategies import load

ALLOWED = ["docx", "pptx", "xlsx", "html"]
MAX_MB = 10.0
LANGUAGES = ["en", "de", "fr"]
MINIMUM = 0.7


def scan_files(spark, folder):
    Corpus(spark, folder)
    files = list_files(spark, folder, "*.parquet")
    return files.select("name", "ext", "size_bytes")


def relevant_files(spark, folder):
    c = Corpus(spark, folder)
    return op.relevant_files(c.listing(), ALLOWED, MAX_MB).select("doc_id", "ext", "size_mb")


def file_identifier(spark, folder):
    c = Corpus(spark, folder)
    return c.listing().select("doc_id", op.file_identifier(F.col("iuuid")).alias("uuid"))


def _keyed_listing(c):
    return c.listing().withColumn("uuid", op.join_identifier(F.col("iuuid")))


def split_new_known(spark, folder):
    c = Corpus(spark, folder)
    marked = op.mark_known(_keyed_listing(c), c.known_links())
    return marked.select("doc_id", "data_location_id", "uuid", "is_known")


def relink_fresh(spark, folder):
    c = Corpus(spark, folder)
    out = op.relink_known(_keyed_listing(c), c.known_links(), F.lit(7))
    return out.select("scan_id", "user_doc_id", F.coalesce("tracked_folder_id", F.lit(-1)).alias("tracked_folder_id"))


def fan_out_files(spark, folder):
    """A document as a container: every line is one contained file."""
    c = Corpus(spark, folder)
    items = c.documents().select("doc_id", "name", "text")
    out = op.fan_out(items, F.split("text", "\n", -1))
    return out.select(
        "doc_id",
        F.col("part_no").cast("bigint").alias("part_no"),
        F.concat_ws("#", "name", F.col("part_no").cast("string")).alias("member"),
        F.md5(F.col("part").cast("binary")).alias("part_md5"),
    )


def ingest_record(spark, folder):
    c = Corpus(spark, folder)
    out = op.ingest_record(c.listing(), F.lit(7))
    return out.withColumns(
        {"tracked_folder": F.coalesce("tracked_folder", F.lit(-1)), "ext": F.coalesce("ext", F.lit(""))}
    )


def _mail_events(c):
    zone = (
        F.when(F.col("event_id") % 5 == 0, " +0100")
        .when(F.col("event_id") % 5 == 1, " -0530")
        .when(F.col("event_id") % 5 == 2, " GMT")
        .when(F.col("event_id") % 5 == 3, " EST (winter)")
        .otherwise("")
    )
    stamp = F.date_format("ts", "E, d MMM yyyy HH:mm:ss")
    return c.raw("events").select("event_id", F.concat(stamp, zone).alias("header"))


def mail_dates(spark, folder):
    c = Corpus(spark, folder)
    parsed = _mail_events(c).withColumn("utc", parse_mail_date(F.col("header")))
    return parsed.select(
        "event_id",
        F.coalesce(F.date_format("utc", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("utc"),
        F.when(F.col("utc").isNull(), "bad_date").otherwise("").alias("reject_reason"),
    )


def ingest_rejects(spark, folder):
    c = Corpus(spark, folder)
    listing = c.listing().withColumns(
        {
            "listing_error": F.when(F.col("doc_id") % 13 == 0, "timeout"),
            "mail_date": F.when(
                F.col("doc_id") % 9 == 0,
                F.concat(
                    F.date_format("created", "d MMM yyyy HH:mm:ss"),
                    F.when(F.col("doc_id") % 2 == 0, " +0200").otherwise(""),
                ),
            ),
        }
    )
    routed = op.with_reject_reason(listing, ALLOWED, MAX_MB)
    return routed.select("doc_id", F.coalesce(op.REASON, F.lit("")).alias(op.REASON))


def tag_folder(spark, folder):
    c = Corpus(spark, folder)
    out = op.tag_folder(c.user_documents(), c.folders())
    return out.select("user_doc_id", "doc_id", "private")


def assign_groups(spark, folder):
    c = Corpus(spark, folder)
    out = op.assign_groups(c.user_documents(), c.folders())
    return out.select("doc_id", "tracked_folder_id", F.concat_ws(",", "access_groups").alias("access_groups"))


def dedupe_documents(spark, folder):
    c = Corpus(spark, folder)
    arrivals = c.documents().select("doc_id", "company_id", "md5", "name")
    return op.dedupe_documents(arrivals).select("doc_id", "company_id", "canonical_doc_id", "is_new")


def dedupe_against_store(spark, folder):
    """Later documents arrive where the others are already stored."""
    c = Corpus(spark, folder)
    docs = c.documents().select("doc_id", "company_id", "md5", "name")
    store, arrivals = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 <> 0")
    return op.dedupe_documents(arrivals, store).select("doc_id", "company_id", "canonical_doc_id", "is_new")


def admit_documents(spark, folder):
    c = Corpus(spark, folder)
    return op.admit_documents(c.documents(), LANGUAGES, MINIMUM).select("doc_id", "lang", "admission")


def language_of_documents(spark, folder):
    c = Corpus(spark, folder)
    out = detect_language(c.raw("documents").select("doc_id", "lang", "text"))
    return out.select(
        "doc_id",
        F.coalesce("detected_lang", F.lit("")).alias("detected_lang"),
        F.round("detected_probability", 6).alias("probability"),
        F.coalesce(F.col("detected_lang") == F.col("lang"), F.lit(False)).alias("is_right"),
    )


def extract_text(spark, folder):
    c = Corpus(spark, folder)
    return c.raw("pages").select(
        "page_id", html_title(F.col("html")).alias("title"), html_text(F.col("html")).alias("text")
    )


def document_record(spark, folder):
    c = Corpus(spark, folder)
    files = c.documents().join(c.listing().select("doc_id", "created"), "doc_id").select(
        "name",
        F.md5(F.col("text").cast("binary")).alias("text"),
        "lang",
        F.col("text").cast("binary").alias("content"),
        F.coalesce("ext", F.lit("")).alias("ext"),
        F.col("created").alias("modified"),
        "lang_probability",
    )
    return op.document_record(files).withColumn("language_probability", F.round("language_probability", 6))


def replace_results(spark, folder):
    """Store results of all companies, then recompute companies 1 and 2; 2 has no hits any more."""
    c = Corpus(spark, folder)
    docs = c.documents().select("company_id", "doc_id", "name")
    store = SnapshotTable(spark, new_path(spark, "results"), docs.schema, "company_id")
    store.replace(docs, [r[0] for r in docs.select("company_id").distinct().collect()])
    store.replace(docs.filter("company_id = 1 AND doc_id % 2 = 0"), [1, 2])
    return store.read()


def delete_documents(spark, folder):
    """Delete one user's documents from the store: rows deleted and left, from the versions before and after."""
    c = Corpus(spark, folder)
    docs = c.documents().select("company_id", "doc_id")
    store = SnapshotTable(spark, new_path(spark, "store"), docs.schema, "company_id")
    before = store.replace(docs, [r[0] for r in docs.select("company_id").distinct().collect()])
    doomed = c.user_documents().filter("user_id = 3").join(docs, "doc_id").select("company_id", "doc_id")
    after = store.delete(doomed, ["doc_id"])
    was = store.read(before).groupBy("company_id").agg(F.count(F.lit(1)).alias("was"))
    left = store.read(after).groupBy("company_id").agg(F.count(F.lit(1)).alias("remaining"))
    both = was.join(left, "company_id", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)))
    return both.select("company_id", (F.col("was") - F.col("remaining")).alias("deleted"), "remaining")


def strategy_files(spark, folder):
    """The folder's files by the named strategy, each part listed by a task of its own."""
    Corpus(spark, folder)
    return load(spark, "folder_files", folder, content=False).select("name", "ext", "size_bytes")


def fetch_new_files(spark, folder):
    """Files of the folder that are not linked yet, opened: those whose path has an even hash are linked."""
    listing = list_files(spark, folder, "*.parquet").withColumns({"data_location_id": F.lit(1), "uuid": op.join_identifier(F.col("iuuid"))})
    linked = listing.filter(F.crc32(F.col("name").cast("binary")) % 2 == 0).select("data_location_id", "uuid")
    wanted = op.new_files(listing, linked).select("path", "name", "size_bytes")
    found = fetch(wanted, part_bytes=PART_BYTES).filter("is_last")
    return found.select("name", "size_bytes", (F.col("end") == F.col("size_bytes")).alias("is_whole"), "md5")


def normalize_extension(spark, folder):
    c = Corpus(spark, folder)
    path = F.regexp_replace("url", r"[?#].*$", "")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(path, F.lit("..TXT."))).otherwise(path)
    return c.raw("pages").select(
        "page_id", F.coalesce(op.normalize_extension(name), F.lit("")).alias("ext")
    )


QUERIES = {
    "scan_files": scan_files,
    "relevant_files": relevant_files,
    "file_identifier": file_identifier,
    "split_new_known": split_new_known,
    "relink_fresh": relink_fresh,
    "fan_out_files": fan_out_files,
    "ingest_record": ingest_record,
    "parse_mail_date": mail_dates,
    "ingest_rejects": ingest_rejects,
    "tag_folder": tag_folder,
    "assign_groups": assign_groups,
    "dedupe_documents": dedupe_documents,
    "dedupe_against_store": dedupe_against_store,
    "admit_documents": admit_documents,
    "detect_language": language_of_documents,
    "extract_text": extract_text,
    "document_record": document_record,
    "replace_results": replace_results,
    "delete_documents": delete_documents,
    "fetch_new_files": fetch_new_files,
    "strategy_files": strategy_files,
    "normalize_extension": normalize_extension,
}

_ALLOWED_SQL = ", ".join(f"'{x}'" for x in ALLOWED)

# CRC-32 by its definition: a 256-entry remainder table, then one table step per byte.
_CRC = """crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k:
             CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(n)))"""
_CRC_OF = """xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(iuuid, ''), lambda ch: ord(ch)::BIGINT)),
      lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1])), 4294967295)::VARCHAR"""


def _html_sql(column: str) -> str:
    sql = column
    for pattern in DROPPED:
        sql = f"regexp_replace({sql}, '{pattern}', ' ', 'g')"
    sql = f"regexp_replace({sql}, '(?s)<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({_entities_sql(sql)}, '[ \\t\\r\\n]+', ' ', 'g'))"


# The references that the oracle decodes, the ampersand last.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'",
    "&copy;": "©", "&reg;": "®", "&middot;": "·", "&ndash;": "–", "&mdash;": "—",
    "&hellip;": "…", "&amp;": "&",
}


def _entities_sql(sql: str) -> str:
    for name, char in ENTITIES.items():
        sql = "replace(%s, '%s', '%s')" % (sql, name, char.replace("'", "''"))
    return sql


_PROFILE_ROWS = ", ".join(f"('{lang}', '{w}')" for lang, ws in PROFILES.items() for w in ws)

_DEDUPE = """SELECT doc_id, company_id, min(doc_id) OVER w AS canonical_doc_id,
    doc_id = min(doc_id) OVER w AS is_new FROM fx_documents
    WINDOW w AS (PARTITION BY company_id, md5, name)"""

ORACLE = {
    "relevant_files": with_ctes(["fx_listing"], f"""
        SELECT doc_id, ext, size_mb FROM fx_listing
        WHERE ext IS NOT NULL AND size_mb <= {MAX_MB} AND ext IN ({_ALLOWED_SQL})"""),
    "file_identifier": with_ctes(["fx_listing"], "SELECT 1").replace(
        " SELECT 1", f", {_CRC} SELECT doc_id, {_CRC_OF} AS uuid FROM fx_listing, crc_table"),
    "split_new_known": with_ctes(["fx_known"], """
        SELECT doc_id, data_location_id, sha256(iuuid) AS uuid,
               EXISTS (SELECT 1 FROM fx_known k WHERE k.uuid = sha256(l.iuuid)
                       AND k.data_location_id = l.data_location_id) AS is_known FROM fx_listing l"""),
    "relink_fresh": with_ctes(["fx_known"], """
        SELECT DISTINCT 7 AS scan_id, user_doc_id, coalesce(tracked_folder_id, -1) AS tracked_folder_id
        FROM fx_known k JOIN fx_listing l
          ON k.uuid = sha256(l.iuuid) AND k.data_location_id = l.data_location_id"""),
    "fan_out_files": with_ctes(["fx_documents"], """
        SELECT doc_id, no - 1 AS part_no, name || '#' || (no - 1) AS member, md5(part) AS part_md5
        FROM (SELECT doc_id, name, unnest(parts) AS part, generate_subscripts(parts, 1) AS no
              FROM (SELECT doc_id, name, string_split(text, chr(10)) AS parts FROM fx_documents))"""),
    "ingest_record": with_ctes(["fx_listing"], "SELECT 1").replace(
        " SELECT 1", f""", {_CRC} SELECT {_CRC_OF} AS uuid, {_CRC_OF} AS storage_key, path AS original_path,
        strftime(created, '%Y-%m-%d %H:%M:%S') AS "timestamp", name, 7 AS scan_id,
        coalesce(ext, '') AS ext, coalesce(tracked_folder_id, -1) AS tracked_folder
        FROM fx_listing, crc_table"""),
    "parse_mail_date": """
        SELECT event_id, CASE WHEN event_id % 5 = 4 THEN '' ELSE strftime(date_trunc('second', ts)
            - to_minutes(CASE event_id % 5 WHEN 0 THEN 60 WHEN 1 THEN -330 WHEN 2 THEN 0 ELSE -300 END),
            '%Y-%m-%d %H:%M:%S') END AS utc,
            CASE WHEN event_id % 5 = 4 THEN 'bad_date' ELSE '' END AS reject_reason FROM events""",
    "ingest_rejects": with_ctes(["fx_listing"], f"""
        SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'listing_error' WHEN ext IS NULL THEN 'no_extension'
            WHEN size_mb > {MAX_MB} THEN 'too_big' WHEN ext NOT IN ({_ALLOWED_SQL}) THEN 'extension_not_allowed'
            WHEN doc_id % 9 = 0 AND doc_id % 2 = 1 THEN 'bad_date' ELSE '' END AS reject_reason
        FROM fx_listing"""),
    "tag_folder": with_ctes(["fx_folders"], """
        SELECT user_doc_id, doc_id, coalesce(f.private, u.private) AS private
        FROM fx_user_documents u LEFT JOIN fx_folders f USING (tracked_folder_id)"""),
    "assign_groups": with_ctes(["fx_folders"], """
        SELECT doc_id, tracked_folder_id, array_to_string(access_groups, ',') AS access_groups FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, user_doc_id DESC) AS rn
          FROM fx_user_documents JOIN fx_folders USING (tracked_folder_id))
        WHERE rn = 1 AND len(access_groups) > 0"""),
    "dedupe_documents": with_ctes(["fx_documents"], _DEDUPE),
    "dedupe_against_store": with_ctes(["fx_documents"], """
        SELECT a.doc_id, a.company_id, coalesce(
            (SELECT min(s.doc_id) FROM fx_documents s WHERE s.doc_id % 3 = 0
             AND (s.company_id, s.md5, s.name) = (a.company_id, a.md5, a.name)),
            min(a.doc_id) OVER w) AS canonical_doc_id,
            a.doc_id = min(a.doc_id) OVER w AND NOT EXISTS (SELECT 1 FROM fx_documents s WHERE s.doc_id % 3 = 0
             AND (s.company_id, s.md5, s.name) = (a.company_id, a.md5, a.name)) AS is_new
        FROM fx_documents a WHERE a.doc_id % 3 <> 0 WINDOW w AS (PARTITION BY a.company_id, a.md5, a.name)"""),
    "admit_documents": with_ctes(["fx_documents"], f"""
        SELECT doc_id, lang, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language'
            WHEN lang_probability < {MINIMUM} THEN 'probability' WHEN text = '' THEN 'empty'
            ELSE 'ok' END AS admission FROM fx_documents"""),
    "detect_language": f"""
        WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS w
                       FROM documents),
        hits AS (SELECT doc_id, p.lang, count(*) AS n FROM words
                 JOIN (VALUES {_PROFILE_ROWS}) AS p(lang, w) USING (w) GROUP BY ALL),
        best AS (SELECT doc_id, lang AS found, n / sum(n) OVER (PARTITION BY doc_id) AS p,
                        row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS rn FROM hits)
        SELECT doc_id, coalesce(found, '') AS detected_lang, round(coalesce(p, 0)::DOUBLE, 6) AS probability,
               coalesce(found = lang, false) AS is_right
        FROM documents LEFT JOIN (SELECT * FROM best WHERE rn = 1) USING (doc_id)""",
    "extract_text": f"""
        SELECT page_id, {_entities_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
               {_html_sql('html')} AS text FROM pages""",
    "document_record": with_ctes(["fx_listing"], """
        SELECT d.name, md5(d.text) AS text, lang AS language, md5(d.text) AS md5, coalesce(d.ext, '') AS extension,
               octet_length(encode(d.text))::BIGINT AS size, epoch(created)::BIGINT AS last_modified,
               round(lang_probability, 6) AS language_probability
        FROM fx_documents d JOIN fx_listing USING (doc_id)"""),
    "replace_results": with_ctes(["fx_documents"], """
        SELECT company_id, doc_id, name FROM fx_documents
        WHERE company_id = 0 OR (company_id = 1 AND doc_id % 2 = 0)"""),
    "delete_documents": with_ctes(["fx_documents", "fx_user_documents"], """
        SELECT company_id, count(*) FILTER (gone) AS deleted, count(*) FILTER (NOT gone) AS remaining
        FROM (SELECT company_id, doc_id IN (SELECT doc_id FROM fx_user_documents WHERE user_id = 3) AS gone
              FROM fx_documents) GROUP BY company_id"""),
    "normalize_extension": r"""
        SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'txt'
            WHEN contains(last, '.') THEN lower(trim(split_part(last, '.', -1), '.')) ELSE '' END AS ext
        FROM (SELECT page_id, split_part(regexp_replace(url, '[?#].*$', ''), '/', -1) AS last FROM pages)""",
}
