"""Registered queries for classification and model selection, with oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from inkspan.operators import classify as op
from inkspan.operators import linear
from inkspan.operators import selection as sel
from inkspan.operators.features import extension_code, spark_stop_words, term_counts
from inkspan.operators.language import detect_language
from inkspan.plans.features import all_features
from inkspan.plans.fixtures import Corpus, with_ctes
from inkspan.sources.staging import stage

FOLDS = 5
STAMP = "2024-06-01 00:00:00"
LANGS = ["de", "en", "es", "fr"]


def model_weights(c):
    """A linear model per language for the root (classes: regions) and per region (classes: nations).

    Weights follow from a rule over language, class and feature numbers.
    """
    region, nation = c.raw("region"), c.raw("nation")
    langs = F.explode(F.array(*[F.struct(F.lit(i).alias("l"), F.lit(x).alias("language")) for i, x in enumerate(LANGS)]))
    features = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("feature_no")

    def weights(df, category, label, number):
        rows = df.select(category.alias("category_id"), label.alias("label"), number.alias("k"), langs.alias("x"))
        rows = rows.select("category_id", "label", "k", "x.l", "x.language", features)
        return rows.select(
            "language",
            "category_id",
            F.concat_ws(":", "language", "category_id", F.lit("v1")).alias("classifier_id"),
            "label",
            "feature_no",
            (((F.col("k") * 7 + F.col("feature_no") * 3 + F.col("l") * 5) % 11) / F.lit(10.0) - 0.5).alias("weight"),
        )

    root = weights(
        region, F.lit(None).cast("string"), F.concat(F.lit("R"), "r_regionkey"), F.col("r_regionkey")
    )
    # regions 0 to 3 have a model of their own, region 4 is a leaf
    below = weights(
        nation.filter("n_regionkey < 4"),
        F.concat(F.lit("R"), "n_regionkey"),
        F.concat(F.lit("N"), "n_nationkey"),
        F.col("n_nationkey"),
    )
    return root.unionByName(below)


def dense_docs(c):
    features = F.array(
        (F.col("size") % 7).cast("double"), extension_code(F.col("ext")).cast("double"), F.lit(1.0)
    )
    return c.documents().select("doc_id", "lang", features.alias("features"))


def predictions(c):
    return op.hierarchical_classify(dense_docs(c), op.pack_models(model_weights(c)), max_depth=3)


def _term_weights(c):
    """Weights of every word seen in the benchmark items, per class, by rule on the word's hash."""
    words = term_counts(c.raw("benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    number = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 4), 16, 10).cast("bigint")
    classes = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    known = words.select("term").distinct().select(F.col("term").alias("feature"), number.alias("h"), classes).select(
        "feature",
        F.concat(F.lit("class_"), "k").alias("label"),
        (((F.col("h") * (F.col("k") + 3)) % 17) / F.lit(170.0) - 0.05).alias("weight"),
    )
    base = c.spark.range(3).select(
        F.lit(op.INTERCEPT).alias("feature"),
        F.concat(F.lit("class_"), F.col("id").cast("string")).alias("label"),
        ((F.col("id") - 1) / F.lit(10.0)).alias("weight"),
    )
    return known.unionByName(base)


def predict_proba(spark, folder):
    c = Corpus(spark, folder)
    counts = term_counts(c.raw("documents").select("doc_id", "text"))
    features = counts.select("doc_id", F.col("term").alias("feature"), F.col("tf").cast("double").alias("value"))
    # rounded scores keep the winner of exact copies the same in any summation order
    features = op.with_intercept(features, c.raw("documents"))
    scores = op.score_features(features, _term_weights(c)).withColumn("score", F.round("score", 6))
    out = op.predict_proba(scores)
    return out.select("doc_id", F.col("label").alias("predicted"), F.explode("probabilities").alias("label", "p")).select(
        "doc_id", "predicted", "label", F.round("p", 6).alias("p")
    )


def confidence(spark, folder):
    """Stored predictions whose label is not always the most probable class."""
    c = Corpus(spark, folder)
    p = (F.col("doc_id") % 10) / F.lit(10.0)
    docs = c.raw("documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, "b").otherwise("a").alias("label"),
        F.create_map(F.lit("a"), p, F.lit("b"), 1 - p).alias("probabilities"),
    )
    return docs.select(
        "doc_id", "label", F.round(op.confidence(F.col("label"), F.col("probabilities")), 6).alias("confidence")
    )


def hierarchical_classify(spark, folder):
    out = predictions(Corpus(spark, folder))
    return out.withColumn("confidence", F.round("confidence", 6))


def classification_rows(spark, folder):
    rows = op.classification_rows(predictions(Corpus(spark, folder)), F.to_timestamp(F.lit(STAMP)))
    return rows.withColumns(
        {"confidence": F.round("confidence", 6), "ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")}
    )


def validated_short_circuit(spark, folder):
    """Documents validated by a human keep stored classes; the rest are classified or set aside."""
    c = Corpus(spark, folder)
    docs = c.documents()
    validated = c.classifications().filter("validated").select("doc_id", F.lit(True).alias("is_validated")).distinct()
    asked = c.user_documents().select(
        F.when(F.col("user_doc_id") % 50 == 1, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id")
    ).distinct()
    text = F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.col("text"))
    known = docs.select("doc_id", text.alias("text"), F.lit(True).alias("found"))
    joined = asked.join(known, "doc_id", "left").join(validated, "doc_id", "left")
    routed = op.route_for_classification(
        joined.withColumn("is_validated", F.coalesce("is_validated", F.lit(False)))
    )
    out = op.routed_classes(routed, c.classifications(), predictions(c))
    return out.select("doc_id", "route", "depth", "category_id", F.round("confidence", 6).alias("confidence"))


def default_language(spark, folder):
    c = Corpus(spark, folder)
    lang = F.when(F.col("doc_id") % 4 != 0, F.col("lang"))
    return c.raw("documents").select("doc_id", op.language_or_default(lang, "da").alias("language"))


def label_result(spark, folder):
    c = Corpus(spark, folder)
    out = op.label_results(c.documents(), c.classifications(), c.categories())
    lines = F.transform("classes", lambda x: F.concat_ws("|", x["name"], F.format_number(x["confidence"], 2), x["clf"]))
    return out.select("doc_id", "md5", F.array_join(lines, ";").alias("classes"))


def leaf_label(spark, folder):
    c = Corpus(spark, folder)
    return op.leaf_labels(c.classifications())


def _labelled(c):
    return c.labelled().select("doc_id", "label")


def rare_label_filter(spark, folder):
    c = Corpus(spark, folder)
    return sel.drop_rare_labels(op.leaf_labels(c.classifications()), 16)


def stratified_sample(spark, folder):
    return sel.stratified_sample(_labelled(Corpus(spark, folder)), 0.4)


def stratified_kfold(spark, folder):
    return sel.validation_splits(_labelled(Corpus(spark, folder)), FOLDS)


def resume_folds(spark, folder):
    """A fold is done when every document in it has been looked at (toxic = 0)."""
    c = Corpus(spark, folder)
    folds = sel.stratified_folds(_labelled(c), 40)
    looked = folds.join(c.raw("labels").select("doc_id", "toxic"), "doc_id")
    results = looked.groupBy("fold").agg((F.max("toxic") == 0).alias("is_done"))
    return sel.pending_folds(folds, results)


def micro_f1(spark, folder):
    c = Corpus(spark, folder)
    out = detect_language(c.raw("documents").select("doc_id", "lang", "text"))
    scored = out.select(F.col("lang").alias("label"), F.col("detected_lang").alias("prediction"))
    return sel.micro_f1(scored).withColumn("micro_f1", F.round("micro_f1", 6))


def _with_folds(docs, folds):
    """Documents with a label and a fold, and those without a label."""
    marked = sel.stratified_folds(docs.filter("label IS NOT NULL").select("doc_id", "label"), folds)
    return stage(docs.select("doc_id").join(marked, "doc_id", "left"), "folds")


def _quality(c):
    labels = c.raw("labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return c.raw("documents").select("doc_id").join(labels, "doc_id", "left")


def _confidences(models, margins):
    out = linear.predictions(margins, models)
    return out.select("doc_id", "label", F.round(op.confidence(F.col("label"), F.col("probabilities")), 6).alias("confidence"))


def fit_classifier(spark, folder):
    """Quality of all documents over all features: labelled ones by the model of the other folds, the rest by that of all."""
    c = Corpus(spark, folder)
    docs = _with_folds(_quality(c), 4)
    return _confidences(*linear.train(docs, stage(all_features(c), "features"), linear.LOGISTIC, 10.0, 4, 25))


def linear_models(spark, folder):
    """Language of all documents, learned from the labelled ones: support vector models of all labels, calibrated."""
    c = Corpus(spark, folder)
    labels = c.raw("labels").select("doc_id", F.lit(True).alias("known"))
    docs = c.raw("documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    docs = _with_folds(docs.select("doc_id", F.when(F.col("known"), F.col("lang")).alias("label")), 3)
    return _confidences(*linear.train(docs, stage(all_features(c), "features"), linear.HINGE, 1.0, 3, 20))


def grid_search(spark, folder):
    """Accuracy per grid point of a linear model of all languages, over given folds."""
    c = Corpus(spark, folder)
    docs = sel.stratified_folds(c.labelled().select("doc_id", F.col("lang").alias("label")), 3)
    features = stage(all_features(c), "features")
    points = sel.search_model(stage(docs, "folds"), features, "linear_svc", folds=3, iterations=15)
    rows = [(float(p["C"]), p["accuracy"], p["accuracy"] == points[0]["accuracy"]) for p in points]
    return spark.createDataFrame(rows, "c double, accuracy double, is_best boolean")


def rbf_features(spark, folder):
    """Labels of embeddings with a kernel approximation and an L1 logistic regression, each by a model without its fold."""
    c = Corpus(spark, folder)
    rows = c.raw("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("label"), "embedding")
    folds = sel.stratified_folds(rows.select("doc_id", "label"), 3)
    labels = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]
    numbers = spark.createDataFrame([(x, k) for k, x in enumerate(labels)], "label string, label_no int")
    docs = folds.join(numbers, "label").join(rows.select("doc_id", "embedding"), "doc_id")
    size = rows.agg(F.max(F.size("embedding"))).first()[0]
    data = sel.fourier_features(sel.pack_vectors(docs, F.col("embedding")), 0.1, size, 128)
    models = linear.fit_models(data, [f"rbf{j}" for j in range(128)], np.ones(128), labels, linear.LOGISTIC, [10.0], 3, 30)
    margins = linear.held_out_margins(data, models, 10.0)
    models.sigmoids = linear.fit_sigmoids(margins, len(labels))
    return _confidences(models, margins)


def classify_documents(spark, folder):
    """Documents from text to stored classes: features, trained models of a tree (language, then quality), descent, rows.

    Languages are learned at the root, the quality of a language's documents below it.
    """
    c = Corpus(spark, folder)
    features = stage(all_features(c, {x: spark_stop_words(x) for x in LANGS}), "features")
    known = stage(c.labelled().select("doc_id", "lang", "label"), "labelled")
    tasks = [(None, known.select("doc_id", F.col("lang").alias("label")))]
    tasks += [(x, known.filter(F.col("lang") == x).select("doc_id", "label")) for x in LANGS]  # one model per inner node
    weights = []
    for category, rows in tasks:
        packed, names, scales, labels = linear.prepare(rows.withColumn("fold", F.lit(1)), features)
        if len(labels) < 2:
            continue
        models = linear.fit_models(packed, names, scales, labels, linear.LOGISTIC, [10.0], 0, 25)
        weights += [
            ("", category, f"{category or 'root'}:v1", label, feature or op.INTERCEPT, w)
            for label, feature, w in models.weight_rows(10.0)
        ]
    schema = "language string, category_id string, classifier_id string, label string, feature string, weight double"
    table = stage(spark.createDataFrame(weights, schema), "weights")
    docs = c.raw("documents").select("doc_id", F.lit("").alias("lang"))
    rows = op.classification_rows(op.descend(docs, features, table, max_depth=3), F.to_timestamp(F.lit(STAMP)))
    return rows.withColumn("confidence", F.round("confidence", 6))


def _registry(c):
    """A model is fitted for every document's language, and for its region when the id is odd."""
    d = c.classifications().filter("depth = 1").join(c.raw("documents").select("doc_id", "lang"), "doc_id")
    category = F.when(F.col("doc_id") % 2 == 1, F.col("category_id"))
    return d.select(
        F.col("lang").alias("language"),
        category.alias("category_id"),
        F.col("ts").alias("fitted_at"),
        op.classifier_id(F.col("lang"), category, F.col("ts")).alias("classifier_id"),
    )


def model_registry(spark, folder):
    out = op.latest_models(_registry(Corpus(spark, folder)))
    return out.select("language", F.coalesce("category_id", F.lit("")).alias("category_id"), "classifier_id")


def update_classification(spark, folder):
    c = Corpus(spark, folder)
    l = c.raw("labels")
    updates = l.filter("toxic = 1").select(
        "doc_id",
        F.concat(F.lit("N"), (F.col("doc_id") * 7) % 25).alias("category_id"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(STAMP)) + F.col("doc_id")).alias("ts"),
    )
    out = op.update_classification(c.classifications(), updates, c.categories())
    return out.select("doc_id", "depth", "category_id", "classifier_id", "confidence", "validated")


QUERIES = {
    "fit_classifier": fit_classifier,
    "classify_documents": classify_documents,
    "predict_proba": predict_proba,
    "confidence": confidence,
    "hierarchical_classify": hierarchical_classify,
    "classification_rows": classification_rows,
    "validated_short_circuit": validated_short_circuit,
    "default_language": default_language,
    "label_result": label_result,
    "leaf_label": leaf_label,
    "rare_label_filter": rare_label_filter,
    "stratified_sample": stratified_sample,
    "stratified_kfold": stratified_kfold,
    "resume_folds": resume_folds,
    "grid_search": grid_search,
    "micro_f1": micro_f1,
    "linear_models": linear_models,
    "rbf_features": rbf_features,
    "model_registry": model_registry,
    "update_classification": update_classification,
}

_CODE = "CASE ext WHEN 'docx' THEN 1 WHEN 'pptx' THEN 2 WHEN 'xlsx' THEN 3 WHEN 'html' THEN 4 ELSE 0 END"
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"


def _level(number: int, source: str, classes: str) -> str:
    """Scores, winner and its probability for one tree level."""
    return f"""
        SELECT doc_id, lang, {number} AS level, arg_max(label, (s, -k)) AS label, min(clf) AS classifier_id,
               arg_max(e, (s, -k)) / sum(e) AS confidence
        FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY doc_id)) AS e FROM (
          SELECT doc_id, lang, label, k, clf,
                 (size % 7) * (((k * 7 + l * 5) % 11) / 10.0::DOUBLE - 0.5)
                 + ({_CODE}) * (((k * 7 + 3 + l * 5) % 11) / 10.0::DOUBLE - 0.5)
                 + 1.0 * (((k * 7 + 6 + l * 5) % 11) / 10.0::DOUBLE - 0.5) AS s
          FROM {source} JOIN {classes})) GROUP BY doc_id, lang"""


CLASS_CTES = {
    "lang_no": ([], "SELECT * FROM (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3)) AS t(lang, l)"),
    "scored_docs": (["fx_documents", "lang_no"], "SELECT doc_id, lang, l, size, ext FROM fx_documents JOIN lang_no USING (lang)"),
    "root_classes": (["lang_no"], """
        SELECT lang AS language, 'R' || r_regionkey AS label, r_regionkey AS k, lang || ':v1' AS clf FROM region, lang_no"""),
    "level0": (["scored_docs", "root_classes"], _level(0, "scored_docs", "root_classes ON lang = language")),
    "level1_in": (["level0"], """
        SELECT d.*, v.label AS parent FROM scored_docs d JOIN level0 v USING (doc_id)"""),
    "nation_classes": (["lang_no"], """
        SELECT lang AS language, 'R' || n_regionkey AS category, 'N' || n_nationkey AS label, n_nationkey AS k,
               lang || ':R' || n_regionkey || ':v1' AS clf FROM nation, lang_no WHERE n_regionkey < 4"""),
    "level1": (["level1_in", "nation_classes"],
               _level(1, "level1_in", "nation_classes ON lang = language AND parent = category")),
    "predicted": (["level0", "level1"], """
        SELECT doc_id, level, label, classifier_id, round(confidence, 6) AS confidence FROM level0
        UNION ALL SELECT doc_id, level, label, classifier_id, round(confidence, 6) FROM level1"""),
    "folded": (["fx_labelled"], f"""
        SELECT doc_id, label, ntile({FOLDS}) OVER (PARTITION BY label ORDER BY doc_id)::INT AS fold
        FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM fx_labelled) WHERE n >= {FOLDS}"""),
}

ORACLE = {
    "predict_proba": f"""
        WITH terms AS (SELECT doc_id, term, count(*) AS tf FROM (
               SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents)
               WHERE length(term) >= 2 GROUP BY ALL),
        known AS (SELECT DISTINCT term FROM (SELECT unnest({_WORDS.format('text')}) AS term FROM benchmark)
                  WHERE length(term) >= 2),
        weights AS (SELECT term, 'class_' || k AS label,
               ((('0x' || substr(md5(term), 1, 4))::BIGINT * (k + 3)) % 17) / 170.0::DOUBLE - 0.05 AS weight
               FROM known, (VALUES (0), (1), (2)) AS t(k)),
        parts AS (SELECT doc_id, label, tf * weight AS s FROM terms JOIN weights USING (term)
               UNION ALL SELECT doc_id, 'class_' || k, (k - 1) / 10.0::DOUBLE FROM documents, (VALUES (0), (1), (2)) AS t(k)),
        scores AS (SELECT doc_id, label, round(sum(s), 6) AS s FROM parts GROUP BY ALL)
        SELECT doc_id, first_value(label) OVER (PARTITION BY doc_id ORDER BY s DESC, label) AS predicted, label,
               round(exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY doc_id), 6) AS p
        FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS m FROM scores)""",
    "confidence": """
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'b' ELSE 'a' END AS label,
               round(CASE WHEN doc_id % 3 = 0 THEN 1 - (doc_id % 10) / 10.0::DOUBLE
                     ELSE (doc_id % 10) / 10.0::DOUBLE END, 6) AS confidence FROM documents""",
    "hierarchical_classify": with_ctes(["predicted"], "SELECT * FROM predicted", CLASS_CTES),
    "classification_rows": with_ctes(["predicted"], f"""
        SELECT doc_id, label AS category_id, level AS depth, classifier_id, confidence, false AS validated,
               '{STAMP}' AS ts FROM predicted""", CLASS_CTES),
    "validated_short_circuit": with_ctes(["fx_user_documents", "fx_classifications", "predicted"], """
        SELECT doc_id, route, depth, category_id, round(confidence, 6) AS confidence FROM (
        SELECT doc_id, CASE WHEN doc_id < 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'empty'
               WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'stored' ELSE 'classify' END AS route
        FROM (SELECT DISTINCT CASE WHEN user_doc_id % 50 = 1 THEN -doc_id - 1 ELSE doc_id END AS doc_id
              FROM fx_user_documents)) LEFT JOIN (
          SELECT doc_id, 'stored' AS route, depth, category_id, confidence FROM fx_classifications WHERE validated
          UNION ALL SELECT doc_id, 'classify', level, label, confidence FROM predicted) USING (doc_id, route)""", CLASS_CTES),
    "default_language": """
        SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'da' ELSE lang END AS language FROM documents""",
    "label_result": with_ctes(["fx_classifications", "fx_categories"], """
        SELECT doc_id, md5(text) AS md5, string_agg(name || '|' || printf('%.2f', confidence) || '|' || classifier_id, ';'
               ORDER BY depth) AS classes
        FROM fx_classifications JOIN fx_categories USING (category_id) JOIN documents USING (doc_id) GROUP BY ALL"""),
    "leaf_label": with_ctes(["fx_classifications"], """
        SELECT doc_id, category_id AS label FROM fx_classifications WHERE validated AND depth = 2"""),
    "rare_label_filter": with_ctes(["fx_classifications"], """
        SELECT doc_id, label FROM (SELECT doc_id, category_id AS label, count(*) OVER (PARTITION BY category_id) AS n
          FROM fx_classifications WHERE validated AND depth = 2) WHERE n >= 16"""),
    "stratified_sample": with_ctes(["fx_labelled"], """
        SELECT doc_id, label FROM (SELECT doc_id, label, count(*) OVER (PARTITION BY label) AS n,
            row_number() OVER (PARTITION BY label ORDER BY md5('|' || doc_id), doc_id) AS rn FROM fx_labelled)
        WHERE rn <= round(n * 0.4)"""),
    "stratified_kfold": with_ctes(["folded"], "SELECT * FROM folded", CLASS_CTES),
    "resume_folds": with_ctes(["fx_labelled"], """
        SELECT fold, fold = max(fold) OVER () AS is_next FROM (
          SELECT fold FROM (SELECT doc_id, ntile(40) OVER (PARTITION BY label ORDER BY doc_id)::INT AS fold FROM fx_labelled)
          JOIN labels USING (doc_id) GROUP BY fold HAVING max(toxic) <> 0)"""),
    "micro_f1": "",  # filled below
    "model_registry": with_ctes(["fx_classifications"], """
        SELECT language, coalesce(category_id, '') AS category_id, arg_max(classifier_id, (ts, classifier_id)) AS classifier_id
        FROM (SELECT lang AS language, CASE WHEN doc_id % 2 = 1 THEN category_id END AS category_id, ts,
                lang || CASE WHEN doc_id % 2 = 1 THEN ':' || category_id ELSE '' END || ':'
                || strftime(ts, '%Y-%m-%dT%H:%M:%S') AS classifier_id
              FROM fx_classifications JOIN documents USING (doc_id) WHERE depth = 1) GROUP BY ALL"""),
    "update_classification": with_ctes(["fx_classifications"], """
        , chosen AS (SELECT DISTINCT doc_id, (doc_id * 7) % 25 AS n FROM labels WHERE toxic = 1)
        SELECT doc_id, depth, category_id, classifier_id, confidence, validated FROM fx_classifications
        WHERE NOT (validated AND doc_id IN (SELECT doc_id FROM chosen))
        UNION ALL SELECT doc_id, depth, CASE depth WHEN 0 THEN 'ROOT' WHEN 1 THEN 'R' || n_regionkey ELSE 'N' || n END,
               'human', 1.0::DOUBLE, true
        FROM chosen JOIN nation ON n_nationkey = n, (VALUES (0), (1), (2)) AS t(depth)""").replace(
        ") \n        , chosen", "), chosen"),
}


def _micro_f1_sql() -> str:
    from inkspan.plans.ingest import ORACLE as INGEST

    return f"""SELECT tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1 FROM (
        SELECT count(*) FILTER (is_right) AS tp, count(*) FILTER (NOT is_right AND detected_lang <> '') AS fp,
               count(*) FILTER (NOT is_right) AS fn FROM ({INGEST['detect_language']}))"""


ORACLE["micro_f1"] = _micro_f1_sql()
