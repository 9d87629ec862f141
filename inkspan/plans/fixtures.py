"""Inputs derived from the given tables, once in Spark and once as SQL for the oracles.

Each derivation runs over whole tables and uses only functions both engines share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.session import prepare
from inkspan.sources.tables import spread, table

# Risk keywords per language.
KEYWORDS = {
    "en": ["thtion", "thble", "attion"],
    "de": ["nicht", "enlich"],
    "es": ["ciónas", "ciónue"],
    "fr": ["étion", "èment"],
}

# Tables whose texts are worked on, with their keys.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}

_EXT = ["docx", "pptx", "xlsx", "html", "exe"]
_START = "2024-01-01 00:00:00"


def _minutes(count: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(_START)) + count * 60)


class Corpus:
    """Derived frames over one table folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        df = table(self.spark, self.folder, name)
        return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df

    def documents(self) -> DataFrame:
        d = self.raw("documents")
        code = F.col("n_chars") % 6
        ext = F.when(code == 0, _EXT[0])
        for i in range(1, 5):
            ext = ext.when(code == i, _EXT[i])
        base = F.concat(
            F.lit("doc_"), F.substring("md5", 1, 8), F.lit("_"), (F.col("doc_id") % 2).cast("string")
        )
        return d.select(
            "doc_id",
            (F.col("n_chars") % 3).alias("company_id"),
            "text",
            "lang",
            "source",
            ext.alias("ext"),
            F.col("n_chars").alias("size"),
            F.md5(F.col("text").cast("binary")).alias("md5"),
            (F.lit(1.0) - (F.col("doc_id") % 10) / F.lit(20.0)).alias("lang_probability"),
            (F.col("doc_id") % 7 != 0).alias("is_fresh"),
        ).withColumn("name", F.concat_ws(".", base, F.col("ext")))

    def user_documents(self) -> DataFrame:
        d = self.raw("documents").select(
            "doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 2).cast("int"))).alias("k")
        )
        return d.select(
            (F.col("doc_id") * 2 + F.col("k")).alias("user_doc_id"),
            "doc_id",
            (F.col("doc_id") % 20).alias("data_location_id"),
            ((F.col("doc_id") + F.col("k")) % 5).alias("user_id"),
            F.md5(F.concat_ws(":", "doc_id", "k").cast("binary")).alias("uuid"),
            (F.col("doc_id") % 11 == 0).alias("private"),
            F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 8).alias("tracked_folder_id"),
            _minutes(F.col("doc_id")).alias("ts"),
        )

    def folders(self) -> DataFrame:
        """Tracked folders that occur on links, with their settings."""
        ids = self.user_documents().select("tracked_folder_id").dropna().distinct()
        return ids.select(
            "tracked_folder_id",
            (F.col("tracked_folder_id") % 4 == 0).alias("private"),
            F.when(F.col("tracked_folder_id") == 7, F.array().cast("array<bigint>"))
            .otherwise(F.array(F.col("tracked_folder_id") % 3, F.lit(3).cast("bigint")))
            .alias("access_groups"),
        )

    def listing(self) -> DataFrame:
        return self.documents().select(
            "doc_id",
            (F.col("doc_id") % 20).alias("data_location_id"),
            "name",
            F.concat_ws("/", F.lit(""), "source", "name").alias("path"),
            F.concat_ws("#", F.concat_ws("/", F.lit(""), "source", "name"), "doc_id").alias("iuuid"),
            "ext",
            (F.col("size") / F.lit(1000.0)).alias("size_mb"),
            _minutes(F.col("doc_id")).alias("created"),
            F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 8).alias("tracked_folder_id"),
        )

    def known_links(self) -> DataFrame:
        """Links already stored before the scan: every fourth document, one or two links each."""
        known = self.listing().filter("doc_id % 4 = 0").select(
            "data_location_id",
            F.sha2("iuuid", 256).alias("uuid"),
            "doc_id",
            F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 8 / 4).cast("int"))).alias("k"),
        )
        return known.select(
            "data_location_id", "uuid", (F.col("doc_id") * 2 + F.col("k")).alias("user_doc_id")
        )

    def people(self) -> DataFrame:
        d = self.raw("documents").filter("doc_id % 20 = 0")
        return d.select(
            F.col("doc_id").alias("person_id"),
            (F.col("doc_id") % 3).alias("company_id"),
            F.regexp_extract("text", r"[\p{L}]{2,} [\p{L}]{2,}", 0).alias("name"),
            (F.lit(1) + F.expr("doc_id div 20") % 4).cast("int").alias("relation"),
        )

    def keywords(self) -> DataFrame:
        rows = [(lang, word) for lang, words in KEYWORDS.items() for word in words]
        return self.spark.createDataFrame(rows, "lang string, keyword string")

    def id_texts(self) -> DataFrame:
        o = self.raw("orders")
        sep = (
            F.when(F.col("o_orderkey") % 3 == 0, "-")
            .when(F.col("o_orderkey") % 3 == 1, " - ")
            .otherwise("")
        )
        suffix = F.when(F.col("o_orderkey") % 17 == 0, "XXXX").otherwise(
            F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")
        )
        text = F.concat(
            F.lit("ref "), F.date_format("o_orderdate", "ddMMyy"), sep, suffix, F.lit(", end")
        )
        return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"), F.lit("da").alias("lang"))

    def categories(self) -> DataFrame:
        """Root, one category per region, one per nation; the root has no parent."""
        region = self.raw("region").select(
            F.concat(F.lit("R"), "r_regionkey").alias("category_id"),
            F.col("r_name").alias("name"),
            F.lit("ROOT").alias("parent_id"),
        )
        nation = self.raw("nation").select(
            F.concat(F.lit("N"), "n_nationkey").alias("category_id"),
            F.col("n_name").alias("name"),
            F.concat(F.lit("R"), "n_regionkey").alias("parent_id"),
        )
        root = region.limit(1).select(
            F.lit("ROOT").alias("category_id"),
            F.lit("root").alias("name"),
            F.lit(None).cast("string").alias("parent_id"),
        )
        return root.unionByName(region).unionByName(nation)

    def classifications(self) -> DataFrame:
        """Three rows per document: root, region, nation; validated where a label exists."""
        d = self.raw("documents").select("doc_id", (F.col("doc_id") % 25).cast("int").alias("n_nationkey"))
        d = d.join(self.raw("nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
        d = d.join(
            self.raw("labels").select("doc_id", F.lit(True).alias("_v")).dropDuplicates(["doc_id"]),
            "doc_id",
            "left",
        )
        path = F.array(
            F.struct(F.lit(0).alias("depth"), F.lit("ROOT").alias("category_id")),
            F.struct(F.lit(1).alias("depth"), F.concat(F.lit("R"), "n_regionkey").alias("category_id")),
            F.struct(F.lit(2).alias("depth"), F.concat(F.lit("N"), "n_nationkey").alias("category_id")),
        )
        return d.select(
            "doc_id",
            F.inline(path),
            F.coalesce(F.col("_v"), F.lit(False)).alias("validated"),
        ).select(
            "doc_id",
            "depth",
            "category_id",
            F.concat_ws(":", F.lit("m"), F.col("depth")).alias("classifier_id"),
            ((F.col("doc_id") * 37 + F.col("depth") * 11) % 100 / F.lit(100.0)).alias("confidence"),
            "validated",
            _minutes(F.col("doc_id") + F.col("depth")).alias("ts"),
        )

    def labelled(self) -> DataFrame:
        d = self.raw("documents").select("doc_id", "lang", "text", "n_chars")
        l = self.raw("labels").select("doc_id", "quality")
        return d.join(l, "doc_id").select(
            "doc_id",
            "lang",
            "text",
            "n_chars",
            F.concat_ws("/", "lang", "quality").alias("label"),
        )

    def scan_events(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type").isin("purchase", "error"))
        return e.select(
            (F.col("user_id") % 50).alias("scan_id"),
            F.col("event_id").cast("string").alias("uuid"),
            F.when(F.col("event_type") == "purchase", "ok").otherwise("failed").alias("status"),
            "ts",
        )

    def scans(self) -> DataFrame:
        """Scans with owner and expected total; odd scans expect one more file than ever ends."""
        done = self.scan_events().groupBy("scan_id").agg(F.count_distinct("uuid").alias("n"))
        return done.select(
            "scan_id",
            (F.col("scan_id") % 10).alias("user_id"),
            (F.col("scan_id") % 3).alias("company_id"),
            F.concat(F.lit("source_"), F.col("scan_id") % 4).alias("source_type"),
            (F.col("n") + F.col("scan_id") % 2).alias("expected"),
        )


def _values(pairs: list[tuple[str, str]]) -> str:
    return ", ".join("('%s','%s')" % p for p in pairs)


# The same derivations as common table expressions; the names on the left are what oracles use.
_CTES: dict[str, tuple[list[str], str]] = {
    "fx_documents": ([], """
        SELECT doc_id, n_chars % 3 AS company_id, text, lang, source, ext, n_chars AS size, md5,
               1.0::DOUBLE - (doc_id % 10) / 20.0::DOUBLE AS lang_probability, doc_id % 7 <> 0 AS is_fresh,
               'doc_' || substr(md5, 1, 8) || '_' || (doc_id % 2) || coalesce('.' || ext, '') AS name
        FROM (SELECT *, md5(text) AS md5,
                     CASE n_chars % 6 WHEN 0 THEN 'docx' WHEN 1 THEN 'pptx' WHEN 2 THEN 'xlsx'
                          WHEN 3 THEN 'html' WHEN 4 THEN 'exe' END AS ext FROM documents)"""),
    "fx_user_documents": ([], """
        SELECT 2 * doc_id + k AS user_doc_id, doc_id, doc_id % 20 AS data_location_id,
               (doc_id + k) % 5 AS user_id, md5(doc_id || ':' || k) AS uuid, doc_id % 11 = 0 AS private,
               CASE WHEN doc_id % 3 <> 0 THEN doc_id % 8 END AS tracked_folder_id,
               TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts
        FROM documents, (VALUES (0::BIGINT), (1)) AS t(k) WHERE k <= doc_id % 2"""),
    "fx_folders": (["fx_user_documents"], """
        SELECT DISTINCT tracked_folder_id, tracked_folder_id % 4 = 0 AS private,
               CASE WHEN tracked_folder_id = 7 THEN []::BIGINT[]
                    ELSE [tracked_folder_id % 3, 3::BIGINT] END AS access_groups
        FROM fx_user_documents WHERE tracked_folder_id IS NOT NULL"""),
    "fx_listing": (["fx_documents"], """
        SELECT doc_id, doc_id % 20 AS data_location_id, name, '/' || source || '/' || name AS path,
               '/' || source || '/' || name || '#' || doc_id AS iuuid, ext,
               size / 1000.0::DOUBLE AS size_mb, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created,
               CASE WHEN doc_id % 3 <> 0 THEN doc_id % 8 END AS tracked_folder_id FROM fx_documents"""),
    "fx_known": (["fx_listing"], """
        SELECT data_location_id, sha256(iuuid) AS uuid, 2 * doc_id + k AS user_doc_id
        FROM fx_listing, (VALUES (0::BIGINT), (1)) AS t(k)
        WHERE doc_id % 4 = 0 AND k <= (doc_id % 8) // 4"""),
    "fx_people": ([], """
        SELECT doc_id AS person_id, doc_id % 3 AS company_id,
               regexp_extract(text, '[\\p{L}]{2,} [\\p{L}]{2,}', 0) AS name,
               (1 + (doc_id // 20) % 4)::INT AS relation FROM documents WHERE doc_id % 20 = 0"""),
    "fx_keywords": ([], "SELECT * FROM (VALUES %s) AS t(lang, keyword)"
                    % _values([(k, w) for k, ws in KEYWORDS.items() for w in ws])),
    "fx_id_text": ([], """
        SELECT o_orderkey AS doc_id, 'da' AS lang, 'ref ' || strftime(o_orderdate, '%d%m%y')
               || CASE o_orderkey % 3 WHEN 0 THEN '-' WHEN 1 THEN ' - ' ELSE '' END
               || CASE WHEN o_orderkey % 17 = 0 THEN 'XXXX' ELSE lpad((o_orderkey % 10000)::VARCHAR, 4, '0') END
               || ', end' AS text FROM orders"""),
    "fx_categories": ([], """
        SELECT 'ROOT' AS category_id, 'root' AS name, NULL::VARCHAR AS parent_id
        UNION ALL SELECT 'R' || r_regionkey, r_name, 'ROOT' FROM region
        UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation"""),
    "fx_classifications": ([], """
        SELECT doc_id, depth, CASE depth WHEN 0 THEN 'ROOT' WHEN 1 THEN 'R' || n_regionkey
               ELSE 'N' || n_nationkey END AS category_id, 'm:' || depth AS classifier_id,
               ((doc_id * 37 + depth * 11) % 100) / 100.0::DOUBLE AS confidence,
               doc_id IN (SELECT doc_id FROM labels) AS validated,
               TIMESTAMP '2024-01-01' + to_minutes(doc_id + depth) AS ts
        FROM documents JOIN nation ON n_nationkey = doc_id % 25, (VALUES (0), (1), (2)) AS t(depth)"""),
    "fx_labelled": ([], """
        SELECT doc_id, lang, text, n_chars, lang || '/' || quality AS label
        FROM documents JOIN labels USING (doc_id)"""),
    "fx_scan_events": ([], """
        SELECT user_id % 50 AS scan_id, event_id::VARCHAR AS uuid, ts,
               CASE event_type WHEN 'purchase' THEN 'ok' ELSE 'failed' END AS status
        FROM events WHERE event_type IN ('purchase', 'error')"""),
    "fx_scans": (["fx_scan_events"], """
        SELECT scan_id, scan_id % 10 AS user_id, scan_id % 3 AS company_id,
               'source_' || (scan_id % 4) AS source_type,
               count(DISTINCT uuid) + scan_id % 2 AS expected FROM fx_scan_events GROUP BY scan_id"""),
    # token tables used by several oracles
    "fx_tokens": (["fx_documents"], """
        SELECT doc_id, company_id, lang, field, token, pos - 1 AS pos FROM (
          SELECT doc_id, company_id, lang, field, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos
          FROM (SELECT doc_id, company_id, lang, 'text' AS field,
                       regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS toks FROM fx_documents
                UNION ALL
                SELECT doc_id, company_id, lang, 'name',
                       regexp_extract_all(lower(name), '[\\p{L}\\p{M}\\p{N}_]+') FROM fx_documents))"""),
}


def with_ctes(names: list[str], body: str, extra: dict[str, tuple[list[str], str]] | None = None) -> str:
    """Prepend the named derivations, and what they need, to a SQL body."""
    known = {**_CTES, **(extra or {})}
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for dep in known[name][0]:
            need(dep)
        order.append(name)

    for name in names:
        need(name)
    ctes = ", ".join(f"{n} AS ({known[n][1]})" for n in order)
    head = f"WITH RECURSIVE {ctes} " if ctes else ""
    return head + body
