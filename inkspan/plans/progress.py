"""Registered queries for progress and streaming, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import progress as op
from inkspan.plans.fixtures import Corpus, with_ctes
from inkspan.plans.ingest import LANGUAGES, MINIMUM
from inkspan.sources.staging import new_path
from inkspan.streaming import jobs

EVENT_ENDS = {"purchase": "ok", "error": "failed"}


def _states(c):
    """Scan 3 has not been counted yet, scan 5 found nothing."""
    scans = c.scans().withColumn(
        "expected", F.when(F.col("scan_id") == 5, 0).when(F.col("scan_id") != 3, F.col("expected"))
    )
    return op.with_state(op.scan_progress(scans, c.scan_events()))


def scan_progress(spark, folder):
    """Every end is reported twice; files still count once."""
    c = Corpus(spark, folder)
    ends = c.scan_events()
    out = op.scan_progress(c.scans(), ends.unionByName(ends))
    return out.select("scan_id", "expected", "finished", "ok", "failed", "remaining")


def _event_stream(c, folder):
    events = jobs.file_stream(c.spark, folder, "events.parquet", c.raw("events").schema)
    return events.filter(F.col("event_type").isin(*EVENT_ENDS)).select(
        (F.col("user_id") % 50).alias("scan_id"),
        F.col("event_id").cast("string").alias("uuid"),
        F.when(F.col("event_type") == "purchase", "ok").otherwise("failed").alias("status"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def scan_progress_stream(spark, folder):
    """The same counts from a stream in which every end arrives twice."""
    c = Corpus(spark, folder)
    ends = _event_stream(c, folder)
    path = new_path(spark, "progress")
    twice = ends.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    jobs.progress_stream(twice, path, new_path(spark, "progress-state"), available_now=True).awaitTermination()
    return jobs.latest_counts(spark, path)


def scan_state(spark, folder):
    return _states(Corpus(spark, folder)).select("scan_id", "state")


def all_done(spark, folder):
    states = _states(Corpus(spark, folder))
    users = op.all_done(states, "user_id").select(F.lit("user").alias("owner"), F.col("user_id").alias("id"), "all_done", "total")
    companies = op.all_done(states, "company_id").select(
        F.lit("company").alias("owner"), F.col("company_id").alias("id"), "all_done", "total"
    )
    return users.unionByName(companies)


def _requests(c):
    e = c.raw("events").filter(F.col("event_type").isin("click", "view"))
    return e.select(
        (F.col("user_id") % 3).alias("company_id"),
        F.when(F.col("event_type") == "click", "names_changed").otherwise("scan_finished").alias("trigger"),
        F.col("event_id").alias("request_id"),
        "ts",
    )


def coalesce_recompute(spark, folder):
    """Requests of one day form a batch."""
    c = Corpus(spark, folder)
    daily = _requests(c).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return op.latest_requests(daily, ["company_id", "day"])


def _intake(spark, folder):
    """Documents as a file stream: admitted, de-duplicated, stored."""
    c = Corpus(spark, folder)
    raw = jobs.file_stream(c.spark, folder, "documents.parquet", c.raw("documents").schema)
    files = raw.select(
        "doc_id",
        (F.col("n_chars") % 3).alias("company_id"),
        F.md5(F.col("text").cast("binary")).alias("md5"),
        F.concat(F.lit("doc_"), F.substring(F.md5(F.col("text").cast("binary")), 1, 8)).alias("name"),
        "lang",
        "text",
        (F.lit(1.0) - (F.col("doc_id") % 10) / F.lit(20.0)).alias("lang_probability"),
    )
    path = new_path(spark, "intake")
    jobs.intake_stream(
        files, path, new_path(spark, "intake-state"), LANGUAGES, MINIMUM, available_now=True
    ).awaitTermination()
    return jobs.intake_tables(spark, path, files.schema)


def stream_new_files(spark, folder):
    return _intake(spark, folder)["documents"].select("doc_id", "company_id", "name", "lang")


def stream_links(spark, folder):
    """Every admitted arrival with the document it belongs to."""
    return _intake(spark, folder)["links"]


def stream_rejects(spark, folder):
    """Arrivals that were not admitted, with the reason."""
    return _intake(spark, folder)["rejects"]


def status_events(spark, folder):
    c = Corpus(spark, folder)
    states = _states(c).withColumn("error", F.when(F.col("scan_id") % 4 == 0, "disk full"))
    out = op.status_events(states)
    return out.withColumns(
        {"expected": F.coalesce("expected", F.lit(-1)), "error": F.coalesce("error", F.lit(""))}
    )


def notifications(spark, folder):
    out = op.notifications(_states(Corpus(spark, folder)))
    return out.select(
        "kind", F.coalesce("scan_id", F.lit(-1)).alias("scan_id"), "user_id",
        F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"),
    )


QUERIES = {
    "scan_progress": scan_progress,
    "scan_progress_stream": scan_progress_stream,
    "scan_state": scan_state,
    "all_done": all_done,
    "coalesce_recompute": coalesce_recompute,
    "stream_new_files": stream_new_files,
    "stream_links": stream_links,
    "stream_rejects": stream_rejects,
    "status_events": status_events,
    "notifications": notifications,
}

_EXTRA = {
    "counts": (["fx_scan_events"], """
        SELECT scan_id, count(DISTINCT uuid) AS finished, count(DISTINCT uuid) FILTER (status = 'ok') AS ok,
               count(DISTINCT uuid) FILTER (status = 'failed') AS failed, min(ts) AS first_end, max(ts) AS last_end
        FROM fx_scan_events GROUP BY scan_id"""),
    "states": (["counts", "fx_scans"], """
        SELECT *, CASE WHEN expected IS NULL THEN 'started' WHEN finished >= expected THEN 'done'
                  ELSE 'counting_done' END AS state
        FROM (SELECT * REPLACE (CASE scan_id WHEN 5 THEN 0 WHEN 3 THEN NULL ELSE expected END AS expected) FROM fx_scans)
        JOIN counts USING (scan_id)"""),
}

ORACLE = {
    "scan_progress": with_ctes(["counts", "fx_scans"], """
        SELECT scan_id, expected, finished, ok, failed, greatest(expected - finished, 0) AS remaining
        FROM fx_scans JOIN counts USING (scan_id)""", _EXTRA),
    "scan_progress_stream": with_ctes(["counts"], "SELECT scan_id, finished, ok, failed FROM counts", _EXTRA),
    "scan_state": with_ctes(["states"], "SELECT scan_id, state FROM states", _EXTRA),
    "all_done": with_ctes(["states"], """
        SELECT 'user' AS owner, user_id AS id, bool_and(state = 'done') AS all_done,
               sum(coalesce(expected, 0))::BIGINT AS total FROM states GROUP BY user_id
        UNION ALL SELECT 'company', company_id, bool_and(state = 'done'), sum(coalesce(expected, 0))::BIGINT
        FROM states GROUP BY company_id""", _EXTRA),
    "coalesce_recompute": """
        SELECT user_id % 3 AS company_id, strftime(ts, '%Y-%m-%d') AS day,
               arg_max(CASE event_type WHEN 'click' THEN 'names_changed' ELSE 'scan_finished' END, (ts, event_id)) AS "trigger",
               arg_max(event_id, (ts, event_id)) AS request_id, count(*) - 1 AS revoked
        FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL""",
    "stream_new_files": """
        SELECT doc_id, company_id, name, lang FROM (
          SELECT doc_id, n_chars % 3 AS company_id, 'doc_' || substr(md5(text), 1, 8) AS name, lang,
                 row_number() OVER (PARTITION BY n_chars % 3, md5(text) ORDER BY doc_id) AS rn
          FROM documents WHERE lang IN ('en', 'de', 'fr') AND 1.0::DOUBLE - (doc_id % 10) / 20.0::DOUBLE >= 0.7 AND text <> '')
        WHERE rn = 1""",
    "stream_links": """
        SELECT doc_id, company_id, canonical_doc_id, doc_id = canonical_doc_id AS is_new FROM (
          SELECT doc_id, n_chars % 3 AS company_id, min(doc_id) OVER (PARTITION BY n_chars % 3, md5(text)) AS canonical_doc_id
          FROM documents WHERE lang IN ('en', 'de', 'fr') AND 1.0::DOUBLE - (doc_id % 10) / 20.0::DOUBLE >= 0.7 AND text <> '')""",
    "stream_rejects": """
        SELECT doc_id, n_chars % 3 AS company_id, CASE WHEN lang IS NULL OR lang NOT IN ('en', 'de', 'fr') THEN 'language'
               WHEN 1.0::DOUBLE - (doc_id % 10) / 20.0::DOUBLE < 0.7 THEN 'probability' ELSE 'empty' END AS reason
        FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de', 'fr') OR 1.0::DOUBLE - (doc_id % 10) / 20.0::DOUBLE < 0.7
          OR coalesce(text, '') = ''""",
    "status_events": with_ctes(["states"], """
        SELECT scan_id, source_type AS name, state AS status, coalesce(expected, -1) AS expected, finished,
               CASE WHEN failed = 0 THEN '' WHEN scan_id % 4 = 0 THEN 'disk full' ELSE 'An error happened' END AS error
        FROM states""", _EXTRA),
    "notifications": with_ctes(["states"], """
        SELECT kind, scan_id, user_id, strftime(created, '%Y-%m-%d %H:%M:%S') AS created FROM (
          SELECT 'started' AS kind, scan_id, user_id, first_end AS created FROM states
          UNION ALL SELECT 'done', scan_id, user_id, last_end FROM states WHERE state = 'done'
          UNION ALL SELECT 'all_done', -1, user_id, max(last_end) FROM states GROUP BY user_id
                    HAVING bool_and(state = 'done'))""", _EXTRA),
}
