"""Model selection: samples, folds, scores and searches over grids of named models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.ranking import tile, with_position
from inkspan.operators import linear
from inkspan.operators.features import chi2_scores, select_k_best
from inkspan.sources.staging import stage

# The search grids.
C_VALUES = [1e-2, 1e-1, 1, 10, 1e2]
GAMMA_VALUES = [0.1, 1, 10, 1e2, 1e3]
DEFAULT_FOLDS = 5

# The named models, their kernels and the grids searched (k: features kept by chi-square).
MODELS = {
    "linear_svc_simple": {"kernel": "linear", "C": [1.0]},
    "logistic_regression_simple": {"kernel": "logistic", "C": [1.0]},
    "linear_svc": {"kernel": "linear", "C": C_VALUES},
    "rbf_svc": {"kernel": "rbf", "C": C_VALUES, "gamma": GAMMA_VALUES},
    "dimreduction": {"kernel": "linear", "C": C_VALUES, "k": [1, 10, 100]},
    "dimred_nonlinear": {"kernel": "rbf", "C": C_VALUES, "gamma": GAMMA_VALUES, "k": [10, 20, 100, 500]},
}


def drop_rare_labels(labelled: DataFrame, minimum: int) -> DataFrame:
    """Keep labels with at least ``minimum`` rows. Counting combines map-side; no window per label."""
    frequent = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum)
    return labelled.join(frequent.select("label"), "label", "left_semi")


def stratified_sample(labelled: DataFrame, share: float, seed: str = "") -> DataFrame:
    """Exactly round(share * n) rows of every label, chosen by a hash of the id."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    hashed = labelled.withColumn("_key", key)
    ranked = with_position(hashed, ["label"], [F.col("_key"), F.col("doc_id")], "_place")
    return ranked.filter(F.col("_place") <= F.round(F.col("_place_of") * share)).select(*labelled.columns)


def stratified_folds(labelled: DataFrame, folds: int = DEFAULT_FOLDS) -> DataFrame:
    """Add ``fold`` (1-based): each label's rows in id order, cut into even consecutive folds."""
    ranked = with_position(labelled, ["label"], [F.col("doc_id")], "_place")
    return ranked.withColumn("fold", tile(F.col("_place"), F.col("_place_of"), folds).cast("int")).select(
        *labelled.columns, "fold"
    )


def validation_splits(
    labelled: DataFrame, folds: int = DEFAULT_FOLDS, share: float | None = None
) -> DataFrame:
    """Filter rare labels, then sample, then cut folds, all with the same number of folds."""
    kept = drop_rare_labels(labelled, folds)
    return stratified_folds(kept if share is None else stratified_sample(kept, share), folds)


def pending_folds(folds: DataFrame, results: DataFrame) -> DataFrame:
    """Folds without a finished result, with their place in the order of work: last fold first."""
    done = results.filter("is_done").select("fold").distinct()
    open_ = folds.select("fold").distinct().join(done, "fold", "left_anti")
    # one row per fold; the fold count is a small parameter
    last = open_.agg(F.max("fold").alias("m")).scalar()
    return open_.withColumn("is_next", F.col("fold") == last)


def micro_f1(predictions: DataFrame) -> DataFrame:
    """Micro F1 of (label, prediction) rows, with its sums, in one aggregate.

    For one label per row it equals accuracy; a null prediction counts as a miss only.
    """
    right = F.coalesce(F.col("label") == F.col("prediction"), F.lit(False))
    sums = predictions.agg(
        F.count_if(right).alias("tp"),
        F.count_if(~right & F.col("prediction").isNotNull()).alias("fp"),
        F.count_if(~right).alias("fn"),
    )
    score = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return sums.withColumn("micro_f1", score)


def search_model(
    docs: DataFrame, features: DataFrame, name: str, grid: dict | None = None, folds: int = DEFAULT_FOLDS,
    iterations: int = 30, outputs: int = 128,
) -> list[dict]:
    """Cross-validated accuracy of every grid point of a named model, best first; of equal ones the first in the grid.

    ``docs`` has doc_id, label (any number of labels) and fold (1-based), ``features`` long features of them. All penalties
    and folds of a choice of features are fitted together.
    """
    if name not in MODELS:
        raise KeyError(f"unknown model: {name}")
    spec = {**MODELS[name], **(grid or {})}
    loss = linear.LOGISTIC if spec["kernel"] == "logistic" else linear.HINGE
    points = []
    for k in spec.get("k", [None]):
        kept = features
        if k is not None:
            chosen = select_k_best(chi2_scores(features, docs.select("doc_id", "label")), k)
            kept = stage(features.join(chosen.select("feature"), "feature", "left_semi"), "chosen-features")
        packed, names, scales, labels = linear.prepare(docs, kept)
        for gamma in spec.get("gamma", [None]):
            data, known, sizes = packed, names, scales
            if gamma is not None:
                data = fourier_features(packed, gamma, len(names), outputs)
                known, sizes = [f"rbf{j}" for j in range(outputs)], np.ones(outputs)
            models = linear.fit_models(data, known, sizes, labels, loss, spec["C"], folds, iterations)
            points += [
                {"C": c, "k": k, "gamma": gamma, "accuracy": accuracy} for c, accuracy in linear.accuracies(data, models)
            ]
    return sorted(points, key=lambda p: -p["accuracy"])


def pack_vectors(docs: DataFrame, vectors: Column) -> DataFrame:
    """doc_id, label_no and fold of ``docs`` with a dense vector as packed features."""
    at = F.when(F.size(vectors) > 0, F.sequence(F.lit(0), F.size(vectors) - 1)).otherwise(F.array().cast("array<int>"))
    return docs.select("doc_id", "label_no", "fold", at.alias("at"), vectors.cast("array<double>").alias("values"))


def _images(batch: pa.RecordBatch, weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Rows of a batch times ``weights``, plus ``shift``. A slice of rows at a time: a row of weights is taken for each value."""
    at, values = batch.column("at"), batch.column("values")
    counts = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at, values = at.flatten().to_numpy(), values.flatten().to_numpy()
    ptr = np.concatenate([[0], np.cumsum(counts)])
    image = np.tile(shift, (len(batch), 1))
    for first, stop in linear.bounded_slices(ptr, weights.shape[1]):
        part, row = slice(ptr[first], ptr[stop]), np.repeat(np.arange(first, stop), counts[first:stop])
        np.add.at(image, row, values[part, None] * weights[at[part]])
    return image


def fourier_features(packed: DataFrame, gamma: float, inputs: int, outputs: int, seed: int = 7) -> DataFrame:
    """``packed`` with features whose dot products approximate the RBF kernel exp(-gamma |x - y|^2). Staged.

    Random Fourier features (Rahimi and Recht, 2007); the draw is fixed by the seed.
    """
    def run(batches):
        rng = np.random.default_rng(seed)
        weights = rng.normal(0.0, np.sqrt(2 * gamma), (inputs, outputs))
        shift = rng.uniform(0, 2 * np.pi, outputs)
        for batch in batches:
            made = np.sqrt(2.0 / outputs) * np.cos(_images(batch, weights, shift))
            ptr = pa.array(np.arange(0, made.size + 1, outputs, dtype=np.int32))
            numbers = pa.ListArray.from_arrays(ptr, pa.array(np.tile(np.arange(outputs, dtype=np.int32), len(batch))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "label_no", "fold")), numbers, pa.ListArray.from_arrays(ptr, pa.array(made.ravel()))],
                ["doc_id", "label_no", "fold", "at", "values"],
            )

    kind = packed.schema["doc_id"].dataType.simpleString()
    rows = packed.select("doc_id", "label_no", "fold", "at", "values")
    return stage(rows.mapInArrow(run, f"doc_id {kind}, label_no int, fold int, at array<int>, values array<double>"), "fourier")
