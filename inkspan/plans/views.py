"""Registered queries for the index, search and similarity, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.operators import ingest, records, search, similarity
from inkspan.operators import views as op
from inkspan.operators.features import EXTENSION_GROUPS
from inkspan.plans.fixtures import Corpus, with_ctes
from inkspan.sources.tables import table

ME = 3
MY_GROUPS = [1, 3]
TOP = 5


def links(c):
    paths = c.listing().select("doc_id", "path")
    return c.user_documents().join(paths, "doc_id")


def users(c):
    """User names are customer names with small keys, repeated where names repeat."""
    ids = c.user_documents().select("user_id").distinct()
    return ids.select("user_id", F.concat(F.lit("user_"), F.col("user_id") % 4).alias("username"))


def locations(c):
    ids = c.user_documents().select("data_location_id").distinct()
    return ids.select("data_location_id", F.concat(F.lit("source_"), F.col("data_location_id") % 4).alias("source_type"))


def validated_flags(c):
    v = c.raw("labels").select("doc_id", F.lit(True).alias("_v")).dropDuplicates(["doc_id"])
    return c.raw("documents").select("doc_id").join(v, "doc_id", "left").select(
        "doc_id", F.coalesce("_v", F.lit(False)).alias("is_validated")
    )


def model_and_human_rows(c):
    """Besides validated rows, every validated document keeps one unvalidated model row per level."""
    rows = c.classifications()
    extra = rows.filter("validated AND depth = 2").select(
        "doc_id", "depth", F.concat(F.lit("N"), (F.col("doc_id") + 1) % 25).alias("category_id"),
        "classifier_id", "confidence", F.lit(False).alias("validated"), "ts",
    )
    return rows.unionByName(extra)


def reviews(c):
    l = c.raw("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return l.select("doc_id", (F.col("quality") == 1).alias("ok"), (F.col("toxic") == 1).alias("critical"))


def doc_groups(c):
    return ingest.assign_groups(c.user_documents(), c.folders()).select("doc_id", "access_groups")


def _index(c, link_rows=None, groups=None, explicit=None):
    return op.document_index(
        c.documents(), link_rows if link_rows is not None else links(c), locations(c), users(c),
        model_and_human_rows(c), c.categories(), groups if groups is not None else doc_groups(c), reviews(c),
        validated_flags(c), F.lit(ME), F.array(*[F.lit(g).cast("bigint") for g in MY_GROUPS]), F.lit(False),
        explicit,
    )


def _flat(index):
    return index.select(
        "md5", "id", "size", "language", F.coalesce("extension", F.lit("")).alias("extension"), "name",
        "user_doc_id", "path", F.date_format("upload_date", "yyyy-MM-dd HH:mm:ss").alias("upload_date"),
        "data_location", F.array_join("users", ",").alias("users"),
        F.col("permissions.groups.editable").alias("groups_editable"),
        F.coalesce(F.array_join(F.col("permissions.groups.value").cast("array<string>"), ","), F.lit("")).alias("groups"),
        F.col("permissions.private.editable").alias("private_editable"),
        F.col("permissions.private.value").alias("private"), "ok", "critical",
        F.array_join("categories", ",").alias("categories"),
    )


def document_index(spark, folder):
    return _flat(_index(Corpus(spark, folder)))


def pick_link(spark, folder):
    """For documents divisible by 10 the second link is asked for."""
    c = Corpus(spark, folder)
    asked = F.when(F.col("doc_id") % 10 == 5, F.col("doc_id") * 2 + 1)
    return op.pick_links(c.user_documents(), F.lit(ME), asked).select("doc_id", "user_doc_id", "user_id")


def effective_classes(spark, folder):
    c = Corpus(spark, folder)
    out = op.effective_classes(validated_flags(c), model_and_human_rows(c))
    return out.select("doc_id", "depth", "category_id", "confidence", "validated")


def doc_users(spark, folder):
    c = Corpus(spark, folder)
    return op.doc_users(c.user_documents(), users(c)).distinct()


def access_flags(spark, folder):
    c = Corpus(spark, folder)
    rows = c.user_documents().join(doc_groups(c), "doc_id", "left")
    out = op.access_flags(
        rows, F.lit(ME), F.array(*[F.lit(g).cast("bigint") for g in MY_GROUPS]), F.lit(False)
    )
    return out.select("user_doc_id", "can_see", "private_editable", "groups_editable")


def _groups(c):
    """A group per nation, owning its nation and region; every third one reuses a region's name."""
    n = c.raw("nation").join(c.raw("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("group_id"),
        (F.col("n_nationkey") % 2).cast("bigint").alias("company_id"),
        F.when(F.col("n_nationkey") % 3 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("name"),
    )


def group_names(spark, folder):
    return op.check_group_names(_groups(Corpus(spark, folder)))


def group_documents(spark, folder):
    c = Corpus(spark, folder)
    good = op.check_group_names(_groups(c)).filter("NOT is_duplicate")
    cats = good.select("group_id", F.concat(F.lit("N"), "group_id").alias("category_id"))
    members = good.join(
        c.user_documents().select("user_id").distinct(), F.col("group_id") % 5 == F.col("user_id")
    ).select("group_id", "user_id")
    return op.group_documents(c.classifications(), cats, members)


def category_tree(spark, folder):
    return op.category_tree(Corpus(spark, folder).categories())


def extension_spec(spark, folder):
    """How many documents fall into each extension group."""
    c = Corpus(spark, folder)
    group = F.coalesce(op.extension_group(F.col("ext")), F.lit("none"))
    return c.documents().groupBy(group.alias("extension_group")).agg(F.count(F.lit(1)).alias("n_docs"))


def similar_documents(spark, folder):
    """Class of similar documents of each document, over all texts."""
    c = Corpus(spark, folder)
    return similarity.similar_documents(table(c.spark, folder, "documents").select("doc_id", "text"))


def similar_sets(spark, folder):
    c = Corpus(spark, folder)
    return similarity.similar_sets(similarity.similar_documents(table(c.spark, folder, "documents").select("doc_id", "text")))


def document_stats(spark, folder):
    c = Corpus(spark, folder)
    docs = c.documents().join(
        c.classifications().filter("depth = 1").select("doc_id", F.col("category_id").alias("category")), "doc_id"
    )
    return op.document_stats(docs, ["lang", "source", "category", "is_fresh"])


def rename_keys(spark, folder):
    """Index records out in camel case and back."""
    c = Corpus(spark, folder)
    nested = c.documents().select(
        "doc_id", F.struct(F.col("company_id"), F.struct("is_fresh", "lang_probability").alias("lang_info")).alias("doc_meta")
    )
    camel = records.rename_keys(nested, records.to_camel)
    back = records.rename_keys(camel, records.to_snake)
    return back.join(
        camel.select(F.col("docId").alias("doc_id"), F.col("docMeta.companyId").alias("company")), "doc_id"
    ).select("doc_id", "company", F.col("doc_meta.lang_info.is_fresh").alias("is_fresh"))


def conform_records(spark, folder):
    """Event properties, some made malformed, incomplete or of the wrong type."""
    c = Corpus(spark, folder)
    e, k = F.col("event_id"), F.get_json_object("props", "$.k")
    json = (
        F.when(e % 10 == 1, F.expr("substring(props, 1, length(props) - 1)"))
        .when(e % 10 == 2, F.lit('{"other": 1}'))
        .when(e % 10 == 3, F.lit('{"k": "many"}'))
        .when(e % 10 == 4, F.concat(F.lit('{"k": '), k, F.lit(', "tag": "t"}')))
        .otherwise(F.col("props"))
    )
    schema = T.StructType(
        [T.StructField("k", T.LongType()), T.StructField("tag", T.StringType()), T.StructField("note", T.StringType())]
    )
    rows = c.raw("events").select("event_id", json.alias("body"))
    out = records.conform_records(rows, "body", schema, ["k"], {"tag": F.lit("")})
    return out.select(
        "event_id", F.coalesce("k", F.lit(-1)).alias("k"), F.coalesce("tag", F.lit("null")).alias("tag"),
        F.coalesce("note", F.lit("null")).alias("note"), F.array_join("errors", ",").alias("errors"),
    )


def doc_metadata(spark, folder):
    """The record of the link with the largest id."""
    c = Corpus(spark, folder)
    index = _index(c, explicit=F.col("doc_id") * 2 + 1)
    last = c.user_documents().agg(F.max("user_doc_id")).first()[0]
    return _flat(op.doc_metadata(index, last))


def access_overlay(spark, folder):
    """Hand-set private flags and groups over the stored ones, then the index."""
    c = Corpus(spark, folder)
    e = c.raw("events")
    flags = e.filter("event_type = 'click'").select(
        F.expr("event_id div 5").alias("user_doc_id"), (F.col("user_id") % 2 == 0).alias("private"),
        "ts", F.col("event_id").alias("assignment_id"),
    )
    assigned = e.filter("event_type = 'view'").select(
        F.expr("event_id div 10").alias("doc_id"),
        F.array((F.col("user_id") % 3).cast("bigint")).alias("groups"),
        "ts", F.col("event_id").alias("assignment_id"),
    )
    return _flat(_index(c, op.with_private_flags(links(c), flags), op.with_assigned_groups(doc_groups(c), assigned)))


def search_ranked(spark, folder):
    """Every benchmark item is a query."""
    c = Corpus(spark, folder)
    queries = c.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    out = search.search_ranked(c.documents().select("doc_id", "name", "text"), queries, TOP)
    first = F.regexp_extract(F.lower("highlight"), r"^[\p{L}\p{M}\p{N}_]+", 0)
    return out.select("query_id", "place", "doc_id", "name", "score", first.alias("first_hit"))


QUERIES = {
    "document_index": document_index,
    "pick_link": pick_link,
    "effective_classes": effective_classes,
    "doc_users": doc_users,
    "access_flags": access_flags,
    "group_names": group_names,
    "group_documents": group_documents,
    "category_tree": category_tree,
    "extension_spec": extension_spec,
    "similar_documents": similar_documents,
    "similar_sets": similar_sets,
    "document_stats": document_stats,
    "rename_keys": rename_keys,
    "conform_records": conform_records,
    "doc_metadata": doc_metadata,
    "access_overlay": access_overlay,
    "search_ranked": search_ranked,
}

_CODES = ", ".join(f"('{e}', '{g}')" for g, exts in EXTENSION_GROUPS.items() for e in exts)
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"

def _index_sql(links_cte: str, groups_cte: str, order: str) -> str:
    return f"""
        SELECT md5, d.doc_id AS id, size, d.lang AS language, coalesce(ext, '') AS extension, name, user_doc_id, path,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS upload_date, 'source_' || (data_location_id % 4) AS data_location,
               users, user_id = {ME} AS groups_editable, coalesce(array_to_string(access_groups, ','), '') AS "groups",
               user_id = {ME} AS private_editable, private, coalesce(ok, false) AS ok,
               coalesce(critical, false) AS critical, categories
        FROM fx_documents d
        JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order} (user_id = {ME}) DESC, user_doc_id) AS rn
              FROM {links_cte}) l ON l.doc_id = d.doc_id AND rn = 1
        JOIN (SELECT doc_id, '/' || source || '/' || name AS path FROM fx_documents) p ON p.doc_id = d.doc_id
        JOIN (SELECT doc_id, array_to_string(list_sort(list(DISTINCT 'user_' || (user_id % 4))), ',') AS users
              FROM fx_user_documents GROUP BY doc_id) u ON u.doc_id = d.doc_id
        JOIN (SELECT doc_id, string_agg(name, ',' ORDER BY depth, -confidence, name) AS categories
              FROM effective JOIN fx_categories USING (category_id) GROUP BY doc_id) k ON k.doc_id = d.doc_id
        LEFT JOIN {groups_cte} g ON g.doc_id = d.doc_id
        LEFT JOIN (SELECT doc_id, max(quality) = 1 AS ok, max(toxic) = 1 AS critical FROM labels GROUP BY doc_id) r
          ON r.doc_id = d.doc_id"""


VIEW_CTES = {
    "class_rows": (["fx_classifications"], """
        SELECT doc_id, depth, category_id, confidence, validated FROM fx_classifications
        UNION ALL SELECT doc_id, 2, 'N' || ((doc_id + 1) % 25), confidence, false
        FROM fx_classifications WHERE validated AND depth = 2"""),
    "effective": (["class_rows"], """
        SELECT * FROM class_rows WHERE validated OR doc_id NOT IN (SELECT doc_id FROM labels)"""),
    "inherited": (["fx_folders"], """
        SELECT doc_id, access_groups FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, user_doc_id DESC) AS rn
          FROM fx_user_documents JOIN fx_folders USING (tracked_folder_id))
        WHERE rn = 1 AND len(access_groups) > 0"""),
    "flagged": (["fx_user_documents"], """
        SELECT u.* REPLACE (coalesce(f.private, u.private) AS private) FROM fx_user_documents u LEFT JOIN (
          SELECT event_id // 5 AS user_doc_id, arg_max(user_id % 2 = 0, (ts, event_id)) AS private
          FROM events WHERE event_type = 'click' GROUP BY ALL) f USING (user_doc_id)"""),
    "regrouped": (["inherited"], """
        SELECT doc_id, coalesce(g, access_groups) AS access_groups FROM inherited FULL JOIN (
          SELECT event_id // 10 AS doc_id, arg_max([user_id % 3], (ts, event_id)) AS g
          FROM events WHERE event_type = 'view' GROUP BY ALL) USING (doc_id)"""),
    "group_rows": ([], """
        SELECT n_nationkey::BIGINT AS group_id, (n_nationkey % 2)::BIGINT AS company_id,
               CASE WHEN n_nationkey % 3 = 0 THEN r_name ELSE n_name END AS name
        FROM nation JOIN region ON r_regionkey = n_regionkey"""),
    "checked_groups": (["group_rows"], """
        SELECT *, group_id <> min(group_id) OVER (PARTITION BY company_id, name) AS is_duplicate FROM group_rows"""),
    "shingle_rows": ([], f"""
        SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i
              FROM (SELECT min(doc_id) AS doc_id, {_WORDS.format('text')} AS w FROM documents GROUP BY text))"""),
    "similar_pairs": (["shingle_rows"], """
        SELECT x.doc_id AS a, y.doc_id AS b FROM shingle_rows x JOIN shingle_rows y ON x.s = y.s AND x.doc_id <> y.doc_id
        JOIN (SELECT doc_id, count(*) AS c FROM shingle_rows GROUP BY doc_id) nx ON nx.doc_id = x.doc_id
        JOIN (SELECT doc_id, count(*) AS c FROM shingle_rows GROUP BY doc_id) ny ON ny.doc_id = y.doc_id
        GROUP BY x.doc_id, y.doc_id, nx.c, ny.c HAVING 2 * count(*) >= nx.c + ny.c - count(*)"""),
    "similar_reach": (["similar_pairs"], """
        SELECT doc_id AS node, doc_id AS other FROM documents
        UNION SELECT r.node, p.b FROM similar_reach r JOIN similar_pairs p ON p.a = r.other"""),
    "similar_rows": (["similar_reach"], """
        SELECT doc_id, rep_id, doc_id <> rep_id AS is_copy, class_id
        FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS rep_id FROM documents)
        JOIN (SELECT node, min(other) AS class_id FROM similar_reach GROUP BY node) ON node = rep_id"""),
}

ORACLE = {
    "document_index": with_ctes(
        ["fx_documents", "inherited", "effective", "fx_categories"], _index_sql("fx_user_documents", "inherited", ""), VIEW_CTES),
    "pick_link": with_ctes(["fx_user_documents"], f"""
        SELECT doc_id, user_doc_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY
          (doc_id % 10 = 5 AND user_doc_id = doc_id * 2 + 1) DESC, (user_id = {ME}) DESC, user_doc_id) AS rn
          FROM fx_user_documents) WHERE rn = 1"""),
    "effective_classes": with_ctes(["effective"], "SELECT * FROM effective", VIEW_CTES),
    "doc_users": with_ctes(["fx_user_documents"], """
        SELECT DISTINCT doc_id, 'user_' || (user_id % 4) AS username FROM fx_user_documents"""),
    "access_flags": with_ctes(["inherited"], f"""
        SELECT user_doc_id, user_id = {ME} OR (NOT private AND (access_groups IS NULL OR list_has_any(access_groups, {MY_GROUPS}))) AS can_see,
               user_id = {ME} AS private_editable, user_id = {ME} AS groups_editable
        FROM fx_user_documents LEFT JOIN inherited USING (doc_id)""", VIEW_CTES),
    "group_names": with_ctes(["checked_groups"], "SELECT * FROM checked_groups", VIEW_CTES),
    "group_documents": with_ctes(["checked_groups", "fx_classifications", "fx_user_documents"], """
        SELECT DISTINCT group_id % 5 AS user_id, doc_id FROM fx_classifications
        JOIN checked_groups ON category_id = 'N' || group_id
        WHERE NOT is_duplicate AND group_id % 5 IN (SELECT user_id FROM fx_user_documents)""", VIEW_CTES),
    "category_tree": with_ctes(["fx_categories"], """
        , tree AS (SELECT category_id, name, category_id AS parent, 0 AS depth FROM fx_categories WHERE parent_id IS NULL
          UNION ALL SELECT c.category_id, c.name, c.parent_id, depth + 1 FROM tree JOIN fx_categories c
            ON c.parent_id = tree.category_id)
        SELECT * FROM tree""").replace(") \n        , tree", "), tree"),
    "extension_spec": with_ctes(["fx_documents"], f"""
        SELECT coalesce(g, 'none') AS extension_group, count(*) AS n_docs
        FROM fx_documents LEFT JOIN (VALUES {_CODES}) AS t(e, g) ON e = ext GROUP BY ALL"""),
    "similar_documents": with_ctes(["similar_rows"], "SELECT * FROM similar_rows", VIEW_CTES),
    "similar_sets": with_ctes(["similar_rows"], """
        SELECT class_id, count(*) AS n_docs, count(*) FILTER (NOT is_copy) AS n_texts FROM similar_rows
        GROUP BY class_id HAVING count(*) > 1""", VIEW_CTES),
    "document_stats": with_ctes(["fx_documents", "fx_classifications"], """
        , d AS (SELECT f.*, category_id AS category FROM fx_documents f JOIN fx_classifications USING (doc_id) WHERE depth = 1)
        SELECT 'all' AS dimension, '' AS value, count(*) AS n_docs, sum(size)::BIGINT AS bytes FROM d
        UNION ALL SELECT 'lang', lang, count(*), sum(size)::BIGINT FROM d GROUP BY lang
        UNION ALL SELECT 'source', source, count(*), sum(size)::BIGINT FROM d GROUP BY source
        UNION ALL SELECT 'category', category, count(*), sum(size)::BIGINT FROM d GROUP BY category
        UNION ALL SELECT 'is_fresh', is_fresh::VARCHAR, count(*), sum(size)::BIGINT FROM d GROUP BY is_fresh""").replace(
        ") \n        , d AS", "), d AS"),
    "rename_keys": with_ctes(["fx_documents"], "SELECT doc_id, company_id AS company, is_fresh FROM fx_documents"),
    "conform_records": """
        SELECT event_id, CASE WHEN event_id % 10 IN (1, 2, 3) THEN -1 ELSE (props->>'$.k')::BIGINT END AS k,
               CASE event_id % 10 WHEN 1 THEN 'null' WHEN 4 THEN 't' ELSE '' END AS tag, 'null' AS note,
               CASE event_id % 10 WHEN 1 THEN 'malformed' WHEN 2 THEN 'missing:k' WHEN 3 THEN 'type:k' ELSE '' END AS errors
        FROM events""",
    "doc_metadata": with_ctes(
        ["fx_documents", "inherited", "effective", "fx_categories"],
        "SELECT * FROM (" + _index_sql("fx_user_documents", "inherited", "(user_doc_id = doc_id * 2 + 1) DESC,")
        + ") WHERE user_doc_id = (SELECT max(user_doc_id) FROM fx_user_documents)", VIEW_CTES),
    "access_overlay": with_ctes(
        ["fx_documents", "flagged", "regrouped", "effective", "fx_categories"], _index_sql("flagged", "regrouped", ""), VIEW_CTES),
    "search_ranked": with_ctes(["fx_documents"], f"""
        , words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
              FROM (SELECT doc_id, {_WORDS.format('text')} AS ws FROM fx_documents)),
        lens AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
        tf AS (SELECT doc_id, w, count(*) AS tf, min(i) AS i FROM words GROUP BY ALL),
        df AS (SELECT w, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf
               FROM tf, (SELECT count(*) AS n FROM documents) GROUP BY w, n),
        q AS (SELECT DISTINCT item_id, unnest({_WORDS.format('text')}) AS w FROM benchmark),
        s AS (SELECT item_id, doc_id, arg_min(w, i) AS first_hit,
                     round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / m))), 6) AS score
              FROM q JOIN tf USING (w) JOIN df USING (w) JOIN lens USING (doc_id),
                   (SELECT avg(n) AS m FROM lens) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS place FROM s)
        SELECT item_id AS query_id, place, doc_id, name, score, first_hit
        FROM r JOIN fx_documents USING (doc_id) WHERE place <= {TOP}""").replace(") \n        , words", "), words"),
}
