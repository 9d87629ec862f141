"""From file listings to document rows: filtering, matching against known files, de-duplication."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.dates import parse_mail_date

REASON = "reject_reason"


def normalize_extension(path: Column) -> Column:
    """Extension after the last dot of the file name, without dots, lower-cased; null if none."""
    ext = F.lower(F.regexp_extract(path, r"[.]([^./\\]*)[.]*$", 1))
    return F.when(ext != "", ext)


def is_relevant(ext: Column, size_mb: Column, allowed: Sequence[str], max_mb: float) -> Column:
    """An extension exists, the size is within the limit, and the extension is allowed."""
    return ext.isNotNull() & (ext != "") & (size_mb <= max_mb) & ext.isin(*allowed)


def relevant_files(listing: DataFrame, allowed: Sequence[str], max_mb: float) -> DataFrame:
    return listing.filter(is_relevant(F.col("ext"), F.col("size_mb"), allowed, max_mb))


def file_identifier(identifier: Column) -> Column:
    """Decimal text of the unsigned CRC-32 of the identifier. Too short to join on at scale."""
    return F.crc32(F.encode(identifier, "UTF-8")).cast("string")


def join_identifier(identifier: Column) -> Column:
    """Collision-free key used for joins instead of the 32-bit identifier."""
    return F.sha2(identifier, 256)


def mark_known(listing: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``is_known``: the file is already linked at its data location.

    One pass over the listing instead of a semi and an anti join. Links are reduced to distinct
    keys before the join, so it never multiplies rows.
    """
    keys = ["data_location_id", "uuid"]
    seen = links.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return (
        listing.join(seen, keys, "left")
        .withColumn("is_known", F.coalesce("_seen", F.lit(False)))
        .drop("_seen")
    )


def new_files(listing: DataFrame, links: DataFrame) -> DataFrame:
    return listing.join(links.select("data_location_id", "uuid"), ["data_location_id", "uuid"], "left_anti")


def relink_known(listing: DataFrame, links: DataFrame, scan_id: Column) -> DataFrame:
    """Every stored link of a listed file joins the current scan, with the folder it came from."""
    return (
        links.join(
            listing.select("data_location_id", "uuid", "tracked_folder_id"),
            ["data_location_id", "uuid"],
        )
        .select(scan_id.alias("scan_id"), "user_doc_id", "tracked_folder_id")
        .distinct()
    )


def fan_out(listing: DataFrame, parts: Column) -> DataFrame:
    """One row per file inside a listing item; ``parts`` is an array of byte or text payloads."""
    return listing.select("*", F.posexplode(parts).alias("part_no", "part"))


def ingest_record(files: DataFrame, scan_id: Column, identifier: str = "iuuid") -> DataFrame:
    """The eight-field record handed to document processing."""
    key = file_identifier(F.col(identifier))
    return files.select(
        key.alias("uuid"),
        F.col("path").alias("original_path"),
        key.alias("storage_key"),
        F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("name"),
        scan_id.alias("scan_id"),
        F.col("ext"),
        F.col("tracked_folder_id").alias("tracked_folder"),
    )


def with_reject_reason(listing: DataFrame, allowed: Sequence[str], max_mb: float) -> DataFrame:
    """Give every item a reason to be skipped, or null. A bad item never stops the others."""
    reason = (
        F.when(F.col("listing_error").isNotNull(), "listing_error")
        .when(F.col("ext").isNull() | (F.col("ext") == ""), "no_extension")
        .when(F.col("size_mb").isNull(), "no_size")
        .when(F.col("size_mb") > max_mb, "too_big")
        .when(~F.col("ext").isin(*allowed), "extension_not_allowed")
        .when(F.col("mail_date").isNotNull() & parse_mail_date(F.col("mail_date")).isNull(), "bad_date")
    )
    return listing.withColumn(REASON, reason)


def accepted(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col(REASON).isNull()).drop(REASON)


def rejected(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col(REASON).isNotNull())


def tag_folder(links: DataFrame, folders: DataFrame) -> DataFrame:
    """A link found through a tracked folder takes over the folder's private flag."""
    settings = folders.select("tracked_folder_id", F.col("private").alias("_folder_private"))
    return (
        links.join(settings, "tracked_folder_id", "left")
        .withColumn("private", F.coalesce("_folder_private", "private"))
        .drop("_folder_private")
    )


def assign_groups(links: DataFrame, folders: DataFrame) -> DataFrame:
    """Access groups of each document's latest tracked folder, when that folder has any.

    Latest is by link time, then link id (our rule).
    """
    latest = (
        links.filter(F.col("tracked_folder_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max_by("tracked_folder_id", F.struct("ts", "user_doc_id")).alias("tracked_folder_id"))
    )
    groups = folders.select("tracked_folder_id", "access_groups").filter(F.size("access_groups") > 0)
    return latest.join(groups, "tracked_folder_id").select("doc_id", "tracked_folder_id", "access_groups")


def dedupe_documents(arrivals: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Give each arrival the id of its document; identity is (company, md5, name).

    The first arrival, or the stored document, is the document. Copies are reduced to one row per
    identity with a map-side combining aggregate before anything is joined, so a file that makes
    up a large share of all rows costs one row per task; the join back may be split by AQE
    because the reduced side has one row per key.
    """
    identity = ["company_id", "md5", "name"]

    def same(left: str, right: str) -> Column:
        """Nulls are equal, so an arrival without a name is a document as well."""
        pairs = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in identity]
        return pairs[0] & pairs[1] & pairs[2]

    own = arrivals.groupBy(*identity).agg(F.min("doc_id").alias("_first"))
    if store is not None:
        stored = store.groupBy(*identity).agg(F.min("doc_id").alias("_stored"))
        own = (
            own.alias("o").join(stored.alias("s"), same("o", "s"), "left")
            .select("o.company_id", "o.md5", "o.name", "s._stored", F.coalesce("s._stored", "o._first").alias("_first"))
        )
    else:
        own = own.withColumn("_stored", F.lit(None).cast("bigint"))
    return arrivals.alias("a").join(own.alias("b"), same("a", "b")).select(
        *[F.col(f"a.{c}") for c in arrivals.columns],
        F.col("_first").alias("canonical_doc_id"),
        (F.col("_stored").isNull() & (F.col("doc_id") == F.col("_first"))).alias("is_new"),
    )


def admission_reason(
    lang: Column, probability: Column, text: Column, languages: Sequence[str], minimum: float
) -> Column:
    """Why a document is not admitted, or ``ok``. The language is judged before emptiness."""
    return (
        F.when(lang.isNull() | ~lang.isin(*languages), "language")
        .when(probability < minimum, "probability")
        .when(text.isNull() | (text == ""), "empty")
        .otherwise("ok")
    )


def admit_documents(docs: DataFrame, languages: Sequence[str], minimum: float) -> DataFrame:
    return docs.withColumn(
        "admission",
        admission_reason(F.col("lang"), F.col("lang_probability"), F.col("text"), languages, minimum),
    )


def document_record(files: DataFrame) -> DataFrame:
    """The eight stored columns of a document, from file content and its detected language."""
    return files.select(
        "name",
        "text",
        F.col("lang").alias("language"),
        F.md5("content").alias("md5"),
        F.col("ext").alias("extension"),
        F.length("content").cast("bigint").alias("size"),
        F.unix_timestamp("modified").alias("last_modified"),
        F.col("lang_probability").alias("language_probability"),
    )


def delete_documents(docs: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the number deleted per company (our definition)."""
    ids = doomed.select("company_id", "doc_id").distinct().withColumn("_gone", F.lit(True))
    marked = docs.join(ids, ["company_id", "doc_id"], "left")
    stay = marked.filter(F.col("_gone").isNull()).drop("_gone")
    count = marked.groupBy("company_id").agg(
        F.count("_gone").alias("deleted"), F.count_if(F.col("_gone").isNull()).alias("remaining")
    )
    return stay, count


def open_items(listing: DataFrame, opener: Callable, schema: str) -> DataFrame:
    """Open listing items with user code that may yield many files per item.

    ``opener`` gets an iterator of pandas batches and yields pandas batches, so one item's files
    stream through a task without being held together.
    """
    return listing.mapInPandas(opener, schema)
