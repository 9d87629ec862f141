"""Scan progress from the ends of file tasks.

A file counts once per scan, however often its end is reported, so a rerun or a repeated callback
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_ERROR = "An error happened"


def finished_files(ends: DataFrame) -> DataFrame:
    """(scan_id, uuid, is_ok, ts): one row per file; a file is ok when any of its ends is."""
    return ends.groupBy("scan_id", "uuid").agg(
        F.bool_or(F.col("status") == "ok").alias("is_ok"), F.min("ts").alias("ts")
    )


def scan_counts(files: DataFrame) -> DataFrame:
    """Finished, ok and failed files per scan; combines on the map side, so big scans are no problem."""
    return files.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("finished"),
        F.count_if(F.col("is_ok")).alias("ok"),
        F.count_if(~F.col("is_ok")).alias("failed"),
        F.min("ts").alias("first_end"),
        F.max("ts").alias("last_end"),
    )


def scan_progress(scans: DataFrame, ends: DataFrame) -> DataFrame:
    """Scans with their counts and how many files remain (null while the total is unknown)."""
    counts = scan_counts(finished_files(ends))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("finished", "ok", "failed")}
    return scans.join(counts, "scan_id", "left").withColumns(zero).withColumn(
        "remaining", F.greatest(F.col("expected") - F.col("finished"), F.lit(0))
    )


def with_state(progress: DataFrame) -> DataFrame:
    """started until the total is known, then counting_done, then done; a total of 0 is done at once."""
    return progress.withColumn(
        "state",
        F.when(F.col("expected").isNull(), "started")
        .when(F.col("finished") >= F.col("expected"), "done")
        .otherwise("counting_done"),
    )


def all_done(states: DataFrame, owner: str) -> DataFrame:
    """Per user or company: are all its scans done, and do they hold any file at all?"""
    return states.groupBy(owner).agg(
        F.bool_and(F.col("state") == "done").alias("all_done"),
        F.sum(F.coalesce("expected", F.lit(0))).alias("total"),
    )


def status_events(states: DataFrame) -> DataFrame:
    """Payload rows for clients; a scan with failures carries its error text or the default one."""
    error = F.col("error") if "error" in states.columns else F.lit(None).cast("string")
    return states.select(
        "scan_id",
        F.col("source_type").alias("name"),
        F.col("state").alias("status"),
        "expected",
        "finished",
        F.when(F.col("failed") > 0, F.coalesce(error, F.lit(DEFAULT_ERROR))).alias("error"),
    )


def notifications(states: DataFrame) -> DataFrame:
    """(kind, scan_id, user_id, created): started and done per scan, all_done per user.

    The times are extremes of the ends, so no scan's history has to be sorted.
    """
    started = states.filter("first_end IS NOT NULL").select(
        F.lit("started").alias("kind"), "scan_id", "user_id", F.col("first_end").alias("created")
    )
    done = states.filter("state = 'done'").select(
        F.lit("done").alias("kind"), "scan_id", "user_id", F.col("last_end").alias("created")
    )
    every = (
        states.groupBy("user_id")
        .agg(F.bool_and(F.col("state") == "done").alias("_all"), F.max("last_end").alias("created"))
        .filter("_all")
        .select(F.lit("all_done").alias("kind"), F.lit(None).cast("bigint").alias("scan_id"), "user_id", "created")
    )
    return started.unionByName(done).unionByName(every)


def latest_requests(requests: DataFrame, keys: list[str]) -> DataFrame:
    """One recomputation per key: the newest request wins and the earlier ones are revoked."""
    return requests.groupBy(*keys).agg(
        F.max_by("trigger", F.struct("ts", "request_id")).alias("trigger"),
        F.max(F.struct("ts", "request_id"))["request_id"].alias("request_id"),
        (F.count(F.lit(1)) - 1).alias("revoked"),
    )
