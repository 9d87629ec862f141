"""Applying classifiers: probabilities, descent through the category tree, stored classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.sources.staging import stage


def language_or_default(lang: Column, default: str) -> Column:
    return F.coalesce(lang, F.lit(default))


def softmax(scores: Column) -> Column:
    """Map of class to score as map of class to probability."""
    top = F.array_max(F.map_values(scores))
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return F.transform_values(scores, lambda _, s: F.exp(s - top) / total)


def best_class(scores: Column) -> Column:
    """Class with the highest score; ties go to the class that sorts first."""
    top = F.array_max(F.map_values(scores))
    winners = F.filter(F.map_entries(scores), lambda e: e["value"] == top)
    return F.array_min(F.transform(winners, lambda e: e["key"]))


def confidence(label: Column, probabilities: Column) -> Column:
    """Probability of the predicted label, which need not be the largest one."""
    return F.try_element_at(probabilities, label)


def score_features(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Linear scores from long features: (doc_id, label, score).

    ``weights`` has (label, feature, weight). Features without a weight fall out in the join.
    """
    return (
        features.join(weights, "feature")
        .groupBy("doc_id", "label")
        .agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
    )


INTERCEPT = "(intercept)"  # a feature of every document, with the value 1


def with_intercept(features: DataFrame, docs: DataFrame) -> DataFrame:
    """Long features and the intercept of every document, so that documents without a known feature are scored."""
    constant = docs.select("doc_id", F.lit(INTERCEPT).alias("feature"), F.lit(1.0).alias("value"))
    return features.select("doc_id", "feature", "value").union(constant)


def predict_proba(scores: DataFrame) -> DataFrame:
    """(doc_id, label, probabilities) from scores; a map holds one entry per class of one model."""
    packed = scores.groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "score")))).alias("scores")
    )
    return packed.select(
        "doc_id", best_class(F.col("scores")).alias("label"), softmax(F.col("scores")).alias("probabilities")
    )


def pack_models(weights: DataFrame) -> DataFrame:
    """One row per model from (language, category_id, classifier_id, label, feature_no, weight).

    A root model has a null category_id. ``weights`` becomes a map of class to its weights in
    feature order, so applying a model is a join on its key and no shuffle of features.
    """
    per_class = weights.groupBy("language", "category_id", "classifier_id", "label").agg(
        F.array_sort(F.collect_list(F.struct("feature_no", "weight"))).alias("w")
    )
    return per_class.groupBy("language", "category_id", "classifier_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("label", F.transform("w", lambda x: x["weight"]).alias("w")))
        ).alias("weights")
    )


def hierarchical_classify(docs: DataFrame, models: DataFrame, max_depth: int) -> DataFrame:
    """Classify from the root down while a model exists for the predicted category.

    ``docs`` has (doc_id, lang, features array). Every level emits a row (doc_id, level, label,
    classifier_id, confidence). The path travels inside the row, so each level is one join with
    the model table; the descent ends at ``max_depth`` or when a category would repeat.
    """
    step_type = "array<struct<level:int,label:string,classifier_id:string,confidence:double>>"
    state = docs.select(
        "doc_id",
        "lang",
        "features",
        F.lit("").alias("category"),
        F.array().cast(step_type).alias("path"),
    )
    keyed = models.select(
        F.col("language").alias("lang"),
        F.coalesce("category_id", F.lit("")).alias("category"),
        "classifier_id",
        "weights",
    )
    for level in range(max_depth):
        joined = state.join(keyed, ["lang", "category"], "left")
        scores = F.transform_values(
            "weights",
            lambda _, w: F.aggregate(
                F.zip_with(w, F.col("features"), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
            ),
        )
        scored = joined.withColumn("scores", scores).withColumn("label", best_class(F.col("scores")))
        seen = F.exists("path", lambda p: p["label"] == F.col("label"))
        alive = F.col("scores").isNotNull() & ~seen
        step = F.struct(
            F.lit(level).alias("level"),
            "label",
            "classifier_id",
            confidence(F.col("label"), softmax(F.col("scores"))).alias("confidence"),
        )
        state = scored.select(
            "doc_id",
            "lang",
            "features",
            # a stopped document gets a category no model has
            F.when(alive, F.col("label")).otherwise(F.lit(None).cast("string")).alias("category"),
            F.when(alive, F.array_append("path", step)).otherwise(F.col("path")).alias("path"),
        )
    # an expression, not the bare column: else the path is computed again in an inferred filter
    return state.select("doc_id", F.inline(F.slice("path", 1, max_depth)))


SALTS = 16  # parts of the documents of one model that are scored apart


def descend(docs: DataFrame, features: DataFrame, weights: DataFrame, max_depth: int) -> DataFrame:
    """Classify over long sparse features, from the root down while a model exists for the predicted category.

    ``docs`` has (doc_id, lang), ``features`` (doc_id, feature, value), ``weights`` (language, category_id or null for a
    root, classifier_id, label, feature, weight), the intercept among the features. Emits (doc_id, level, label, classifier_id,
    confidence). Each level is one aggregate by document and class. Documents of one model meet its weights in
    ``SALTS`` parts, as all documents of a language share its root model. The descent ends at ``max_depth`` or
    when a category would repeat.
    """
    known = with_intercept(features, docs)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    keyed = weights.select(
        F.col("language").alias("lang"), F.coalesce("category_id", F.lit("")).alias("category"),
        "classifier_id", "label", "feature", "weight",
    )
    models = keyed.select("lang", "category", "classifier_id").distinct()
    classes = keyed.select("lang", "category", "label").distinct()
    spread = keyed.drop("classifier_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    state = docs.select("doc_id", "lang", F.lit("").alias("category"), F.array().cast("array<string>").alias("seen"))
    out = None
    for level in range(max_depth):
        alive = stage(state.join(models, ["lang", "category"]), "descent")
        if alive.isEmpty():
            break
        asked = known.join(alive.select("doc_id", "lang", "category"), "doc_id").withColumn("salt", salt)
        found = asked.join(spread, ["lang", "category", "feature", "salt"]).groupBy("doc_id", "label").agg(
            F.sum(F.col("value") * F.col("weight")).alias("score")
        )
        # A class none of a document's features has a weight for scores 0.
        every = alive.select("doc_id", "lang", "category").join(classes, ["lang", "category"]).select("doc_id", "label")
        scores = every.join(found, ["doc_id", "label"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
        winners = predict_proba(scores).join(alive, "doc_id").filter(~F.array_contains("seen", F.col("label")))
        step = stage(
            winners.select(
                "doc_id", "lang", F.lit(level).alias("level"), "label", "classifier_id",
                confidence(F.col("label"), F.col("probabilities")).alias("confidence"), F.array_append("seen", F.col("label")).alias("seen"),
            ),
            "descent",
        )
        rows = step.select("doc_id", "level", "label", "classifier_id", "confidence")
        out = rows if out is None else out.unionByName(rows)
        state = step.select("doc_id", "lang", F.col("label").alias("category"), "seen")
    return out if out is not None else docs.select("doc_id", F.lit(0).alias("level"), F.lit("").alias("label"), F.lit("").alias("classifier_id"), F.lit(0.0).alias("confidence")).filter("false")


def classification_rows(predictions: DataFrame, stamp: Column) -> DataFrame:
    """Stored form of predictions; the time is passed in so that a rerun gives the same rows."""
    return predictions.select(
        "doc_id",
        F.col("label").alias("category_id"),
        F.col("level").alias("depth"),
        "classifier_id",
        "confidence",
        F.lit(False).alias("validated"),
        stamp.alias("ts"),
    )


def route_for_classification(docs: DataFrame) -> DataFrame:
    """Add ``route``: stored (validated by a human), missing, empty, or classify."""
    return docs.withColumn(
        "route",
        F.when(F.col("found").isNull() | ~F.col("found"), "missing")
        .when(F.col("text").isNull() | (F.col("text") == ""), "empty")
        .when(F.col("is_validated"), "stored")
        .otherwise("classify"),
    )


def routed_classes(routed: DataFrame, stored: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, route, depth, category_id, confidence): classes by the route of a document.

    Documents validated by a human keep their stored validated rows, documents to classify get the predicted ones; missing
    and empty ones have a single row without a class.
    """
    columns = ["doc_id", "depth", "category_id", "confidence"]
    kept = stored.filter("validated").select(*columns, F.lit("stored").alias("route"))
    fresh = predicted.select(
        "doc_id", F.col("level").alias("depth"), F.col("label").alias("category_id"), "confidence", F.lit("classify").alias("route")
    )
    return routed.select("doc_id", "route").join(kept.unionByName(fresh), ["doc_id", "route"], "left").select(
        "doc_id", "route", "depth", "category_id", "confidence"
    )


def label_results(docs: DataFrame, classifications: DataFrame, categories: DataFrame) -> DataFrame:
    """Per document: md5 and its classes (name, confidence, classifier), in tree order."""
    named = classifications.join(categories.select("category_id", "name"), "category_id")
    entry = F.struct("depth", "name", "confidence", F.col("classifier_id").alias("clf"))
    packed = named.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("classes"))
    return docs.select("doc_id", "md5").join(packed, "doc_id")


def leaf_labels(classifications: DataFrame) -> DataFrame:
    """Deepest validated category per document (our definition)."""
    return classifications.filter("validated").groupBy("doc_id").agg(
        F.max_by("category_id", F.struct("depth", "category_id")).alias("label")
    )


def classifier_id(language: Column, category: Column, fitted_at: Column) -> Column:
    """language[:category]:UTC time of fitting."""
    stamp = F.date_format(fitted_at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat_ws(":", language, category, stamp)


def latest_models(registry: DataFrame) -> DataFrame:
    """The newest model per language and category; a null category is the language's root model."""
    return registry.groupBy("language", "category_id").agg(
        F.max("fitted_at").alias("fitted_at"),
        F.max_by("classifier_id", F.struct("fitted_at", "classifier_id")).alias("classifier_id"),
    )


def ancestors(categories: DataFrame) -> DataFrame:
    """(category_id, ancestor_id, up): every category with itself and all categories above it.

    Steps are taken until one adds nothing, however deep the tree is; a cycle is walked once.
    """
    parents = categories.select(F.col("category_id").alias("_id"), F.col("parent_id").alias("_parent"))
    level = categories.select("category_id", F.col("category_id").alias("ancestor_id"), F.lit(0).alias("up"))
    out = level = stage(level, "ancestors")
    up = 0
    while not level.isEmpty():
        up += 1
        above = level.join(parents, F.col("ancestor_id") == F.col("_id")).filter(F.col("_parent").isNotNull())
        above = above.select("category_id", F.col("_parent").alias("ancestor_id"), F.lit(up).alias("up"))
        level = stage(above.join(out, ["category_id", "ancestor_id"], "left_anti").select(above.columns), "ancestors")
        out = out.unionByName(level)
    return out


def update_classification(stored: DataFrame, updates: DataFrame, categories: DataFrame) -> DataFrame:
    """Add validated rows for a leaf chosen by a human and its ancestors (our definition).

    ``updates`` has (doc_id, category_id, ts). The newest choice per document counts; earlier
    validated rows of that document are replaced, model rows stay.
    """
    chosen = updates.groupBy("doc_id").agg(
        F.max_by("category_id", F.struct("ts", "category_id")).alias("category_id"), F.max("ts").alias("ts")
    )
    lines = ancestors(categories)
    height = F.max("up").over(Window.partitionBy("category_id"))
    paths = lines.withColumn("depth", height - F.col("up"))
    fresh = chosen.join(paths, "category_id").select(
        "doc_id",
        "depth",
        F.col("ancestor_id").alias("category_id"),
        F.lit("human").alias("classifier_id"),
        F.lit(1.0).alias("confidence"),
        F.lit(True).alias("validated"),
        "ts",
    )
    marked = stored.join(
        chosen.select("doc_id", F.lit(True).alias("_chosen")), "doc_id", "left"
    )
    kept = marked.filter(~(F.coalesce("_chosen", F.lit(False)) & F.col("validated"))).drop("_chosen")
    return kept.unionByName(fresh.select(*kept.columns))
