"""The document index and the views around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.sources.staging import stage

from inkspan.operators.features import EXTENSION_GROUPS


def pick_links(links: DataFrame, user_id: Column, explicit: Column | None = None) -> DataFrame:
    """One link per document: the asked one, else one of the user's, else any; ties by link id.

    The choice is an aggregate that combines on the map side, not a window over a document's links.
    """
    asked = F.coalesce(F.col("user_doc_id") == explicit, F.lit(False)) if explicit is not None else F.lit(False)
    rank = F.struct((~asked).alias("a"), (F.col("user_id") != user_id).alias("b"), F.col("user_doc_id").alias("c"))
    values = [c for c in links.columns if c != "doc_id"]
    best = links.groupBy("doc_id").agg(F.min_by(F.struct(*values), rank).alias("_link"))
    return best.select("doc_id", "_link.*")


def effective_classes(docs_validated: DataFrame, classifications: DataFrame) -> DataFrame:
    """Validated rows of validated documents, all rows of the others.

    ``docs_validated`` has (doc_id, is_validated). Order is by depth, then falling confidence.
    """
    joined = classifications.join(docs_validated, "doc_id")
    return joined.filter(~F.col("is_validated") | F.col("validated")).drop("is_validated")


def doc_users(links: DataFrame, users: DataFrame) -> DataFrame:
    """(doc_id, username), each user once per document."""
    return links.select("doc_id", "user_id").distinct().join(users, "user_id").select("doc_id", "username")


def access_flags(
    docs: DataFrame, user_id: Column, user_groups: Column, is_admin: Column
) -> DataFrame:
    """Add ``can_see``, ``private_editable`` and ``groups_editable`` (our definition).

    Private links are for their owner only; otherwise a document without groups is open and one
    with groups needs a shared group. Owners edit the private flag; owners and administrators
    assign groups.
    """
    owner = F.col("user_id") == user_id
    groups = F.coalesce("access_groups", F.array().cast("array<bigint>"))
    shared = (F.size(groups) == 0) | F.arrays_overlap(groups, user_groups)
    return docs.withColumns(
        {
            "can_see": owner | (~F.col("private") & shared),
            "private_editable": owner,
            "groups_editable": owner | is_admin,
        }
    )


def check_group_names(groups: DataFrame) -> DataFrame:
    """Groups with ``is_duplicate``: a name taken by an earlier group of the company is rejected."""
    first = groups.groupBy("company_id", "name").agg(F.min("group_id").alias("_first"))
    return groups.join(first, ["company_id", "name"]).withColumn(
        "is_duplicate", F.col("group_id") != F.col("_first")
    ).drop("_first")


def group_documents(classifications: DataFrame, group_categories: DataFrame, group_users: DataFrame) -> DataFrame:
    """Distinct (user_id, doc_id) seen through groups that own the document's category (our definition)."""
    owned = classifications.select("doc_id", "category_id").join(group_categories, "category_id")
    return (
        owned.select("group_id", "doc_id").distinct().join(group_users, "group_id").select("user_id", "doc_id").distinct()
    )


def category_tree(categories: DataFrame) -> DataFrame:
    """id, name, parent, depth; the root reports itself as parent.

    Levels are added until one is empty, however deep the tree is. A category that is reached again
    (a cycle below the root) is not added twice; categories that no root reaches are left out.
    """
    level = categories.filter("parent_id IS NULL").select("category_id", "name", F.col("category_id").alias("parent"))
    out = level = stage(level.withColumn("depth", F.lit(0)), "level")
    depth = 0
    while not level.isEmpty():
        depth += 1
        above = level.select(F.col("category_id").alias("parent"))
        below = (
            categories.withColumnRenamed("parent_id", "parent")
            .join(above, "parent")
            .join(out.select("category_id"), "category_id", "left_anti")
            .select("category_id", "name", "parent", F.lit(depth).alias("depth"))
        )
        level = stage(below, "level")
        out = out.unionByName(level)
    return out


def extension_group(ext: Column) -> Column:
    """Name of the extension group, null for other extensions."""
    out = None
    for name, exts in EXTENSION_GROUPS.items():
        out = F.when(ext.isin(*exts), name) if out is None else out.when(ext.isin(*exts), name)
    return out


def latest_overlay(assignments: DataFrame, key: str, value: str) -> DataFrame:
    """Newest assigned value per key."""
    return assignments.groupBy(key).agg(F.max_by(value, F.struct("ts", "assignment_id")).alias(f"_new_{value}"))


def with_private_flags(links: DataFrame, assignments: DataFrame) -> DataFrame:
    """Links with the newest private flag set by hand (our definition)."""
    latest = latest_overlay(assignments, "user_doc_id", "private")
    return links.join(latest, "user_doc_id", "left").withColumn(
        "private", F.coalesce("_new_private", "private")
    ).drop("_new_private")


def with_assigned_groups(doc_groups: DataFrame, assignments: DataFrame) -> DataFrame:
    """Document groups with the newest groups assigned by hand (our definition)."""
    latest = latest_overlay(assignments, "doc_id", "groups")
    return doc_groups.join(latest, "doc_id", "full").select(
        "doc_id", F.coalesce("_new_groups", "access_groups").alias("access_groups")
    )


def document_index(
    docs: DataFrame,
    links: DataFrame,
    locations: DataFrame,
    users: DataFrame,
    classifications: DataFrame,
    categories: DataFrame,
    doc_groups: DataFrame,
    reviews: DataFrame,
    validated: DataFrame,
    user_id: Column,
    user_groups: Column,
    is_admin: Column,
    explicit: Column | None = None,
) -> DataFrame:
    """One record per document that has a link and a class.

    User names stay distinct through a map-side combining aggregate; the arrays of a record hold
    users of one document and classes of one path.
    """
    picked = pick_links(links, user_id, explicit)
    names = doc_users(links, users).groupBy("doc_id").agg(F.array_sort(F.collect_set("username")).alias("users"))
    classes = effective_classes(docs.select("doc_id").join(validated, "doc_id"), classifications)
    entry = F.struct("depth", (-F.col("confidence")).alias("_order"), "name", "confidence")
    named = classes.join(categories.select("category_id", "name"), "category_id")
    packed = named.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("_classes"))
    joined = (
        docs.join(picked, "doc_id")
        .join(packed, "doc_id")
        .join(names, "doc_id")
        .join(locations, "data_location_id")
        .join(doc_groups, "doc_id", "left")
        .join(reviews, "doc_id", "left")
    )
    flagged = access_flags(joined, user_id, user_groups, is_admin)
    return flagged.select(
        "md5",
        F.col("doc_id").alias("id"),
        "size",
        F.col("lang").alias("language"),
        F.col("ext").alias("extension"),
        "name",
        "user_doc_id",
        "path",
        F.col("ts").alias("upload_date"),
        F.col("source_type").alias("data_location"),
        "users",
        F.struct(
            F.struct(F.col("groups_editable").alias("editable"), F.col("access_groups").alias("value")).alias("groups"),
            F.struct(F.col("private_editable").alias("editable"), F.col("private").alias("value")).alias("private"),
        ).alias("permissions"),
        F.coalesce("ok", F.lit(False)).alias("ok"),
        F.coalesce("critical", F.lit(False)).alias("critical"),
        F.transform("_classes", lambda c: c["name"]).alias("categories"),
    )


def doc_metadata(index: DataFrame, user_doc_id: int) -> DataFrame:
    """The index record behind one link (our definition)."""
    return index.filter(F.col("user_doc_id") == user_doc_id)


def document_stats(docs: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts and sizes by each dimension on its own, and overall (our definition)."""
    grouping = [F.grouping(d) for d in dimensions]
    out = docs.groupingSets([[F.col(d)] for d in dimensions] + [[]], *dimensions).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("bytes"), *[g.alias(f"_g_{d}") for g, d in zip(grouping, dimensions)]
    )
    dimension = F.lit("all")
    value = F.lit("")
    for d in dimensions:
        dimension = F.when(F.col(f"_g_{d}") == 0, d).otherwise(dimension)
        value = F.when(F.col(f"_g_{d}") == 0, F.coalesce(F.col(d).cast("string"), F.lit(""))).otherwise(value)
    return out.select(dimension.alias("dimension"), value.alias("value"), "n_docs", "bytes")
