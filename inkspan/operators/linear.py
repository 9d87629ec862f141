"""Linear models for all labels, penalties and folds at once.

Documents are packed once, each with its known features and their values. One pass over them per step gives the gradients of
every model: for every label (one against the rest), every penalty and every fold left out. Each task adds up its documents,
the sums of the tasks are added by an aggregate, and the driver takes the step; it holds the weights and nothing of the
documents. Steps are accelerated proximal gradient steps of a size found by a power iteration.

Features are divided by their largest absolute value, so that one step size serves all. The intercept is not penalised.
What is minimised is ``mean loss + |w|_1 / (C n)`` for the logistic loss, ``mean loss + |w|_2^2 / (2 C n)`` for the squared
hinge; ``n`` counts the rows the model learns from.

A labelled document is predicted by the model that did not learn from its fold, any other by the model of all folds.
Margins become probabilities by a sigmoid for each label, fitted on the held-out margins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.sources.staging import stage
from inkspan.sources.tables import dealt

LOGISTIC, HINGE = "logistic", "squared_hinge"
CURVATURE = {LOGISTIC: 0.25, HINGE: 2.0}  # largest second derivative of each loss
VALUES = 1 << 21  # numbers of one intermediate array, about
CLIP = 30.0


@dataclass
class LinearModels:
    """Weights of every (penalty, fold left out): ``weights[m, feature, label]``, the intercept last among the features."""

    features: list[str]
    scales: np.ndarray
    labels: list[str]
    points: list[tuple[float, int]]  # C and the fold left out; fold 0: none
    weights: np.ndarray
    sigmoids: np.ndarray | None = None  # slope and shift by label

    def weight_rows(self, c: float) -> list[tuple[str, str, float]]:
        """(label, feature, weight) that are not 0, of the model of all folds, for features as they come."""
        w = self.weights[self.points.index((c, 0))]
        full = w / np.append(self.scales, 1.0)[:, None]
        return [
            (self.labels[k], self.features[j] if j < len(self.features) else "", float(full[j, k]))
            for j, k in zip(*np.nonzero(full), strict=True)
        ]


def pack_documents(docs: DataFrame, features: DataFrame, names: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``at`` (numbers of the known features) and ``values``. Staged.

    ``names`` has (feature, no, scale), one row per known feature. Features are dealt by document into parts that follow the input.
    """
    known = features.join(names, "feature").select("doc_id", "no", (F.col("value") / F.col("scale")).alias("value"))
    known = dealt(known, "doc_id")
    packed = known.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "value"))).alias("_f"))
    both = docs.join(packed, "doc_id", "left")
    none = F.array().cast("array<struct<no:int,value:double>>")
    filled = both.withColumn("_f", F.coalesce("_f", none))
    return stage(filled.select(*docs.columns, F.col("_f.no").alias("at"), F.col("_f.value").alias("values")), "packed")


def known_features(spark, features: DataFrame) -> tuple[list[str], np.ndarray, DataFrame]:
    """(names in order, largest absolute values, table of (feature, no, scale)). The driver holds the vocabulary."""
    found = features.groupBy("feature").agg(F.max(F.abs("value")).alias("scale")).filter("scale > 0").orderBy("feature").toArrow()
    names, scales = found["feature"].to_pylist(), found["scale"].to_numpy().astype(float)
    rows = pa.table({"feature": pa.array(names, pa.string()), "no": pa.array(range(len(names)), pa.int32()), "scale": scales})
    return names, scales, stage(spark.createDataFrame(rows.to_pandas(), "feature string, no int, scale double"), "names")


def bounded_slices(ptr: np.ndarray, width: int):
    """(first, stop) of runs of rows that begin at ``ptr``; the values of a run times ``width`` stay near ``VALUES``."""
    first, room = 0, max(1, VALUES // max(1, width))
    while first < len(ptr) - 1:
        stop = max(first + 1, int(np.searchsorted(ptr, ptr[first] + room, "right")) - 1)
        yield first, stop
        first = stop


class _Rows:
    """Documents of a batch as one sparse matrix with the intercept as the last feature."""

    def __init__(self, batch: pa.RecordBatch, size: int) -> None:
        at, values = batch.column("at"), batch.column("values")
        counts = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.ptr = np.concatenate([[0], np.cumsum(counts + 1)])
        own = np.ones(self.ptr[-1], bool)
        own[self.ptr[1:] - 1] = False
        self.at, self.values = np.full(self.ptr[-1], size), np.ones(self.ptr[-1])
        self.at[own], self.values[own] = at.flatten().to_numpy(), values.flatten().to_numpy()
        self.row = np.repeat(np.arange(len(counts)), counts + 1)

    def parts(self, width: int):
        """Slices of rows whose values times ``width`` stay bounded."""
        return bounded_slices(self.ptr, width)

    def times(self, weights: np.ndarray, first: int, stop: int) -> np.ndarray:
        part = slice(self.ptr[first], self.ptr[stop])
        return np.add.reduceat(self.values[part, None] * weights[self.at[part]], self.ptr[first:stop] - self.ptr[first])

    def back(self, slopes: np.ndarray, out: np.ndarray, first: int, stop: int) -> None:
        """Adds the transposed product with one row of slopes per document to ``out``."""
        part = slice(self.ptr[first], self.ptr[stop])
        at = self.at[part]
        # numbers of 16 bits are sorted by their digits, in linear time
        order = np.argsort(at.astype(np.uint16) if len(out) <= 1 << 16 else at, kind="stable")
        at = at[order]
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        found = (self.values[part, None] * slopes[self.row[part] - first])[order]
        out[at[head]] += np.add.reduceat(found, head)


def _added(data: DataFrame, size: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """Sum over all batches of what ``add`` adds to an array of ``size`` numbers."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                add(batch, total)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "value"])

    rows = data.mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[rows["slot"].to_numpy()] = rows["value"].to_numpy()
    return out


def _slopes(loss: str, margins: np.ndarray, signs: np.ndarray) -> np.ndarray:
    if loss == LOGISTIC:
        return -signs / (1 + np.exp(np.clip(signs * margins, -CLIP, CLIP)))
    return -2 * signs * np.maximum(1 - signs * margins, 0)


def _signs(no: np.ndarray, labels: int) -> np.ndarray:
    out = -np.ones((len(no), labels))
    out[np.flatnonzero(no >= 0), no[no >= 0]] = 1
    return out


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Label number and fold of each row; -1 where there is none."""
    return tuple(batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False).astype(int) for c in ("label_no", "fold"))


def _largest_curvature(data: DataFrame, size: int, rows: int, steps: int = 8) -> float:
    """About the largest eigenvalue of the mean of x x^T."""
    vector = np.ones(size + 1) / np.sqrt(size + 1)
    value = 1.0
    for _ in range(steps):
        shared = data.sparkSession.sparkContext.broadcast(vector)

        def add(batch, total, shared=shared):
            matrix = _Rows(batch, size)
            used = _columns(batch)[0] >= 0
            for first, stop in matrix.parts(1):
                image = matrix.times(shared.value[:, None], first, stop) * used[first:stop, None]
                matrix.back(image, total[:, None], first, stop)

        image = _added(data, size + 1, add) / max(1, rows)
        value = float(np.linalg.norm(image))
        vector = image / max(value, 1e-12)
    return max(value, 1e-12)


def fit_models(
    packed: DataFrame, features: list[str], scales: np.ndarray, labels: list[str], loss: str, cs: Sequence[float], folds: int,
    iterations: int = 40,
) -> LinearModels:
    """Models for every penalty and for every fold left out, and of all folds. ``packed`` has label_no and fold (1-based)."""
    size, points = len(features), [(float(c), fold) for c in cs for fold in range(folds + 1)]
    learned = packed.filter("label_no >= 0").select("label_no", "fold", "at", "values")  # the others add nothing
    counts = {r["fold"]: r["n"] for r in learned.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    left = np.array([rows - (counts.get(fold, 0) if fold else 0) for _, fold in points])
    penalty = np.array([1 / (c * max(n, 1)) for (c, _), n in zip(points, left, strict=True)])[:, None, None]
    shape, width = (len(points), size + 1, len(labels)), len(points) * len(labels)
    curvature = 1.05 * CURVATURE[loss] * _largest_curvature(learned, size, rows) * rows / np.maximum(left, 1)
    step = (1 / (curvature + (penalty.ravel() if loss == HINGE else 0)))[:, None, None]
    penalised = np.ones((1, size + 1, 1))
    penalised[0, size] = 0
    weights = ahead = np.zeros(shape)
    speed = 1.0
    outs = np.array([fold for _, fold in points])
    for _ in range(iterations if len(labels) > 1 else 0):
        # the size of the models; those of a feature beside each other, so that one product serves all models
        shared = packed.sparkSession.sparkContext.broadcast(np.ascontiguousarray(ahead.transpose(1, 0, 2)).reshape(size + 1, width))

        def add(batch, total, shared=shared):
            now, sums = shared.value, total.reshape(size + 1, width)
            matrix, (no, fold) = _Rows(batch, size), _columns(batch)
            signs = np.tile(_signs(no, len(labels)), len(points))
            for first, stop in matrix.parts(width):
                used = (no[first:stop, None] >= 0) & ((outs == 0) | (fold[first:stop, None] != outs))
                slopes = _slopes(loss, matrix.times(now, first, stop), signs[first:stop]) * np.repeat(used, len(labels), axis=1)
                matrix.back(slopes, sums, first, stop)

        added = _added(learned, (size + 1) * width, add).reshape(size + 1, len(points), len(labels))
        gradient = added.transpose(1, 0, 2) / np.maximum(left, 1)[:, None, None]
        if loss == HINGE:
            gradient = gradient + penalty * penalised * ahead
        moved = ahead - step * gradient
        if loss == LOGISTIC:
            moved = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty * penalised, 0)
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        weights, ahead, speed = moved, moved + (speed - 1) / faster * (moved - weights), faster
    return LinearModels(features, scales, labels, points, weights)


def held_out_margins(packed: DataFrame, models: LinearModels, c: float) -> DataFrame:
    """doc_id, label_no and margins (by label) of every document, by the model that did not learn from it. Staged."""
    shared = packed.sparkSession.sparkContext.broadcast(models)
    kind = packed.schema["doc_id"].dataType.simpleString()

    def run(batches):
        now = shared.value
        place = {fold: m for m, (penalty, fold) in enumerate(now.points) if penalty == c}
        for batch in batches:
            if not len(batch):
                continue
            matrix, (no, fold) = _Rows(batch, len(now.features)), _columns(batch)
            out = np.zeros((len(batch), len(now.labels)))
            for first, stop in matrix.parts(len(now.labels)):
                own = np.where(no[first:stop] >= 0, fold[first:stop], 0)
                for k in np.unique(own):
                    margins = matrix.times(now.weights[place.get(int(k), place[0])], first, stop)
                    out[first:stop][own == k] = margins[own == k]
            ptr = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label_no"), pa.ListArray.from_arrays(pa.array(ptr), pa.array(out.ravel()))],
                ["doc_id", "label_no", "margins"],
            )

    rows = packed.select("doc_id", "label_no", "fold", "at", "values").mapInArrow(run, f"doc_id {kind}, label_no int, margins array<double>")
    return stage(rows, "margins")


def fit_sigmoids(margins: DataFrame, labels: int, steps: int = 12) -> np.ndarray:
    """Slope and shift of a sigmoid for each label, by Newton steps over the labelled rows, all labels in a pass."""
    out = np.tile([1.0, 0.0], (labels, 1))
    for _ in range(steps):
        shared = margins.sparkSession.sparkContext.broadcast(out)

        def add(batch, total, shared=shared):
            no = batch.column("label_no").fill_null(-1).to_numpy(zero_copy_only=False).astype(int)
            z = batch.column("margins").flatten().to_numpy().reshape(len(batch), labels)[no >= 0]
            y = (_signs(no[no >= 0], labels) + 1) / 2
            p = 1 / (1 + np.exp(-np.clip(z * shared.value[:, 0] + shared.value[:, 1], -CLIP, CLIP)))
            spread = p * (1 - p)
            for k, part in enumerate(((p - y) * z, p - y, spread * z * z, spread * z, spread)):
                total[k * labels : (k + 1) * labels] += part.sum(axis=0)

        a, b, aa, ab, bb = _added(margins, 5 * labels, add).reshape(5, labels)
        aa, bb = aa + 1e-6, bb + 1e-6  # keeps separable labels finite
        a, b = a + 1e-6 * out[:, 0], b + 1e-6 * out[:, 1]
        scale = np.maximum(aa * bb - ab * ab, 1e-12)
        move = np.stack([(bb * a - ab * b) / scale, (aa * b - ab * a) / scale], axis=1)
        out = out - np.clip(move, -2, 2)
    return out


def predictions(margins: DataFrame, models: LinearModels) -> DataFrame:
    """(doc_id, label, probabilities): the label with the largest margin, and each label's share of the probabilities."""
    names = F.array(*[F.lit(x) for x in models.labels])
    slopes, shifts = (F.array(*[F.lit(float(v)) for v in models.sigmoids[:, k]]) for k in (0, 1))
    raw = F.transform("margins", lambda m, i: 1 / (1 + F.exp(-(m * F.get(slopes, i) + F.get(shifts, i)))))
    best = F.array_position("margins", F.array_max("margins")).cast("int")
    shared = margins.withColumn("_p", raw).withColumn("_sum", F.aggregate("_p", F.lit(0.0), lambda acc, p: acc + p))
    share = F.transform("_p", lambda p: p / F.col("_sum"))
    return shared.select("doc_id", F.element_at(names, best).alias("label"), F.map_from_arrays(names, share).alias("probabilities"))


def prepare(docs: DataFrame, features: DataFrame) -> tuple[DataFrame, list[str], np.ndarray, list[str]]:
    """(packed, features, scales, labels) from docs (doc_id, label or null, fold) and long features of all of them."""
    spark = docs.sparkSession
    labels = [r[0] for r in docs.select("label").filter("label IS NOT NULL").distinct().orderBy("label").collect()]
    learned = features.join(docs.filter("label IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    names, scales, table = known_features(spark, learned)
    numbers = spark.createDataFrame([(x, k) for k, x in enumerate(labels)], "label string, label_no int")
    numbered = docs.join(numbers, "label", "left").select("doc_id", "label_no", "fold")
    return pack_documents(numbered, features, table), names, scales, labels


def train(
    docs: DataFrame, features: DataFrame, loss: str = LOGISTIC, c: float = 1.0, folds: int = 3, iterations: int = 40
) -> tuple[LinearModels, DataFrame]:
    """The models and the margins of every document."""
    packed, names, scales, labels = prepare(docs, features)
    models = fit_models(packed, names, scales, labels, loss, [c], folds, iterations)
    margins = held_out_margins(packed, models, float(c))
    models.sigmoids = fit_sigmoids(margins, len(labels))
    return models, margins


def accuracies(packed: DataFrame, models: LinearModels) -> list[tuple[float, float]]:
    """(C, share of labelled rows whose held-out margin is largest for their label)."""
    out = []
    for c in dict.fromkeys(c for c, _ in models.points):
        margins = held_out_margins(packed, models, c).filter("label_no >= 0")
        hit = F.array_position("margins", F.array_max("margins")) == F.col("label_no") + 1
        out.append((c, float(margins.agg(F.avg(hit.cast("double"))).first()[0] or 0.0)))
    return out
