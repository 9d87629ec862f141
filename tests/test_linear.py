"""Linear models of all labels against a dense solver, held-out predictions, searches and the descent."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkspan.operators import classify, linear, selection

C = 5.0


def objective(loss, w, x, signs, c):
    m = signs * (x @ w[:-1] + w[-1])
    value = np.logaddexp(0, -m).mean() if loss == linear.LOGISTIC else (np.maximum(1 - m, 0) ** 2).mean()
    size = np.abs(w[:-1]).sum() if loss == linear.LOGISTIC else (w[:-1] ** 2).sum() / 2
    return value + size / (c * len(x))


def dense(loss, x, signs, c, steps=6000):
    """Plain proximal gradient steps on a dense matrix."""
    full = np.hstack([x, np.ones((len(x), 1))])
    step = 1 / (linear.CURVATURE[loss] * np.linalg.eigvalsh(full.T @ full / len(x))[-1] + 1 / (c * len(x)))
    w = np.zeros(full.shape[1])
    for _ in range(steps):
        slopes = linear._slopes(loss, full @ w, signs)
        gradient = full.T @ slopes / len(x)
        if loss == linear.HINGE:
            gradient[:-1] += w[:-1] / (c * len(x))
        w = w - step * gradient
        if loss == linear.LOGISTIC:
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step / (c * len(x)), 0)
    return w


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.random((240, 6)) * (rng.random((240, 6)) < 0.6) * [1, 2, 30, 1, 1, 1]
    labels = np.array(["a", "b", "c"])[(x[:, :3] / [1, 2, 30] + rng.normal(0, 0.15, (240, 3))).argmax(axis=1)]
    rows = [(k, None if k >= 200 else str(labels[k]), k % 3 + 1 if k < 200 else None) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, label string, fold int")
    long = [(k, f"f{j}", float(x[k, j])) for k in range(240) for j in range(6) if x[k, j]]
    return x, labels, docs, spark.createDataFrame(long, "doc_id long, feature string, value double")


@pytest.mark.parametrize("loss", [linear.LOGISTIC, linear.HINGE])
def test_models_reach_the_optimum_of_a_dense_solver(data, loss):
    x, labels, docs, features = data
    packed, names, scales, found = linear.prepare(docs, features)
    assert names == [f"f{j}" for j in range(6)] and found == ["a", "b", "c"]
    models = linear.fit_models(packed, names, scales, found, loss, [0.5, C], 3, 150)
    scaled = x / scales
    for c, fold in [(0.5, 0), (C, 0), (C, 2)]:
        used = (np.arange(240) < 200) & (np.arange(240) % 3 + 1 != fold)
        for k, name in enumerate(found):
            signs = np.where(labels[used] == name, 1.0, -1.0)
            best = objective(loss, dense(loss, scaled[used], signs, c), scaled[used], signs, c)
            own = models.weights[models.points.index((c, fold))][:, k]
            assert objective(loss, own, scaled[used], signs, c) <= best * 1.002 + 1e-6


def test_rows_are_predicted_by_models_that_did_not_learn_from_them(data):
    x, labels, docs, features = data
    packed, names, scales, found = linear.prepare(docs, features)
    models = linear.fit_models(packed, names, scales, found, linear.LOGISTIC, [C], 3, 30)
    full = np.hstack([x / scales, np.ones((240, 1))])
    for r in linear.held_out_margins(packed, models, C).collect():
        fold = r.doc_id % 3 + 1 if r.doc_id < 200 else 0
        assert np.allclose(r.margins, full[r.doc_id] @ models.weights[models.points.index((C, fold))])


def test_predictions_are_right_and_sum_to_one(data):
    _, labels, docs, features = data
    models, margins = linear.train(docs, features, linear.HINGE, C, 3, 60)
    rows = linear.predictions(margins, models).collect()
    assert len(rows) == 240 and np.mean([r.label == labels[r.doc_id] for r in rows]) > 0.75
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-9 and set(r.probabilities) == {"a", "b", "c"} for r in rows)


def test_very_many_labels(spark):
    """More labels than the old bound; one fit for all."""
    rows = [(k, f"l{k % 1200:04d}", k // 1200 + 1) for k in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, label string, fold int")
    features = docs.select("doc_id", F.concat(F.lit("w"), F.substring("label", 2, 3)).alias("feature"), F.lit(1.0).alias("value"))
    features = features.union(docs.select("doc_id", F.concat(F.lit("v"), F.substring("label", 5, 1)), F.lit(1.0)))
    models, margins = linear.train(docs, features, linear.HINGE, 1000.0, 2, 3)
    assert len(models.labels) == 1200 and linear.predictions(margins, models).count() == 2400


@pytest.mark.parametrize("name", ["logistic_regression_simple", "dimred_nonlinear"])
def test_named_models(data, name):
    _, _, docs, features = data
    grid = {"C": [10.0], **({"k": [3], "gamma": [0.5]} if name.startswith("dimred") else {})}
    points = selection.search_model(docs.filter("label IS NOT NULL"), features, name, grid, 3, 40, 64)
    assert len(points) == 1 and points[0]["accuracy"] > 0.7


def test_unknown_model():
    with pytest.raises(KeyError):
        selection.search_model(None, None, "other")


def test_descent_over_sparse_features(spark):
    docs = spark.createDataFrame([(1, "en"), (2, "en"), (3, "en"), (4, "xx")], "doc_id long, lang string")
    features = spark.createDataFrame([(1, "f", 2.0), (2, "f", -1.0), (2, "g", 1.0), (9, "f", 1.0)], "doc_id long, feature string, value double")
    w = [("en", None, "m0", "A", "f", 1.0), ("en", None, "m0", "B", "f", -1.0), ("en", None, "m0", "B", classify.INTERCEPT, 0.5)]
    w += [("en", "A", "m1", "A1", "f", 1.0), ("en", "A", "m1", "A2", "f", 2.0), ("en", "B", "m2", "A", "g", 5.0), ("en", "B", "m2", "B", "g", 1.0)]
    weights = spark.createDataFrame(w, "language string, category_id string, classifier_id string, label string, feature string, weight double")
    got = {(r.doc_id, r.level): (r.label, r.classifier_id, round(r.confidence, 4)) for r in classify.descend(docs, features, weights, 5).collect()}
    assert got[1, 0] == ("A", "m0", round(1 / (1 + np.exp(-3.5)), 4)) and got[1, 1] == ("A2", "m1", round(1 / (1 + np.exp(-2)), 4))
    # From B to A, and from there to A1 (both score by a value of -1); a category never repeats.
    assert [got[2, k][0] for k in range(3)] == ["B", "A", "A1"] and got[3, 0][0] == "B" and {k[0] for k in got} == {1, 2, 3}
    # Without any known feature the classes of a model tie and the first one wins.
    assert got[3, 1][0] == "A" and got[3, 1][2] == 0.5


def test_rows_without_a_label_cost_no_step(spark):
    """The fit does not multiply them: their feature numbers are unknown here, which a product would trip over."""
    rows = [(k, k % 2, k % 3 + 1, [0, 1], [float(k % 2), 0.5]) for k in range(12)] + [(90, None, None, [7, 9], [1.0, 1.0])]
    packed = spark.createDataFrame(rows, "doc_id long, label_no int, fold int, at array<int>, values array<double>")
    models = linear.fit_models(packed, ["x", "y"], np.ones(2), ["a", "b"], linear.LOGISTIC, [1.0, 10.0], 3, 5)
    assert models.weights.shape == (8, 3, 2) and np.isfinite(models.weights).all() and models.weights[4, 0, 1] > 0


def test_images_are_made_in_slices():
    """A row of weights is taken for each value, but only for a bounded slice of a batch at once."""
    rows, inputs, outputs = 4000, 64, 128
    x = np.random.default_rng(5).random((rows, inputs))
    at = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * inputs + 1, inputs), pa.int32()), pa.array(np.tile(np.arange(inputs), rows), pa.int32()))
    values = pa.ListArray.from_arrays(at.offsets, pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([at, values], ["at", "values"])
    weights, shift = np.random.default_rng(6).random((inputs, outputs)), np.arange(float(outputs))
    tracemalloc.start()
    image = selection._images(batch, weights, shift)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(image, x @ weights + shift)
    assert peak < 8 * (4 * linear.VALUES + 2 * image.size) < 8 * rows * inputs * outputs
