"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic model over hashed words and word
beginnings; the document's score is the noisy-or of its sentences, ``1 - prod(1 - p)``. Only documents
carry labels: the likelihood of the noisy-or is maximised, which makes single sentences answer for a
toxic document and lets the model point at them afterwards.

Defined cases: a null or empty text has no sentence, score 0 and no offending span. Repeated rows are
scored one by one; a document with contradicting labels counts as toxic. Without labels, or with one
kind only, every score stays near the starting bias. Computed columns replace columns of their name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.frames import append_columns, bounded_batches, column, fresh_name
from inkspan.llm.wordhash import NOT_ALNUM, char_index, mix, words_of

BITS = 20
PREFIXES = (3, 4, 5)  # bytes at a word's beginning
MAX_FIT_DOCUMENTS = 16_000
MAX_FIT_BYTES = 64 << 20
SCORE_BYTES = 1 << 20  # of the texts scored at once; features take many times their size
EPOCHS, BATCH, RATE, DECAY, BIAS = 15, 128, 0.3, 0.01, -5.0
# A feature keeps weight 0 unless its labels tell (see ``telling``): without evidence it would learn its documents by
# heart. In fewer than MIN_DOCUMENTS no evidence counts.
MIN_DOCUMENTS = 3

SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[[ord(c) for c in ".!?\n"]] = True

SPANS = "array<struct<start:int,end:int,score:double>>"


class Bags:
    """Features of a batch: ``ids`` by word, words by sentence, sentences by document."""

    def __init__(self, texts: pa.Array) -> None:
        words = words_of(texts, NOT_ALNUM, True, PREFIXES)
        shift = np.uint64(64 - BITS)
        kinds = [words.hash, *words.prefixes]
        self.ids = np.stack(
            [(mix(h + np.uint64(k + 1)) >> shift).astype(np.int32) for k, h in enumerate(kinds)], axis=1
        )
        self.words, row = words, words.row
        ends = np.cumsum(SENTENCE_END[words.data]) if len(words.data) else np.zeros(0, np.int64)
        before = ends[words.start] if len(words.start) else words.start
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (before[1:] != before[:-1])
        self.sentence_ptr = np.append(np.flatnonzero(fresh), len(row))
        self.document_ptr = np.searchsorted(self.sentence_ptr[:-1], words.row_ptr)

    def sentence_logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(0)
        return bias + np.add.reduceat(weights[self.ids].sum(axis=1), self.sentence_ptr[:-1])


def _sum_by(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[ptr[1:]] - total[ptr[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def noisy_or(logits: np.ndarray, document_ptr: np.ndarray) -> np.ndarray:
    """1 - prod(1 - sigmoid(logit)) per document; 0 without sentences."""
    return -np.expm1(-np.abs(_sum_by(np.logaddexp(0, logits), document_ptr)))


def telling(seen: np.ndarray, toxic: np.ndarray, rate: float) -> np.ndarray:
    """Features whose share of toxic documents is not chance, whatever the size of the sample.

    ``exp(-n * KL(share, rate))`` bounds the chance of such a share among ``n`` documents; it has to stay below one
    in as many as there are features to try.
    """
    tried = seen >= MIN_DOCUMENTS
    share = np.where(tried, toxic / np.maximum(seen, 1), rate)
    rate = min(max(rate, 1e-9), 1 - 1e-9)
    apart = share * np.log(np.maximum(share, 1e-300) / rate)
    apart += (1 - share) * np.log(np.maximum(1 - share, 1e-300) / (1 - rate))
    return tried & (seen * apart >= np.log(max(2, tried.sum())))


class _Group:
    """A few fitting documents: usable features (``place`` above 0) with the sentence each stands in."""

    def __init__(self, bags: Bags, place: np.ndarray, labels: np.ndarray) -> None:
        found = place[bags.ids]
        of_word = np.repeat(np.arange(len(bags.sentence_ptr) - 1), np.diff(bags.sentence_ptr))
        kept = found > 0
        self.feature = found[kept]
        self.sentence = np.broadcast_to(of_word[:, None], found.shape)[kept].astype(np.int32)
        self.document_ptr, self.labels = bags.document_ptr, labels

    def step(self, few: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        """Gradient of the noisy-or likelihood by the usable features and by the bias."""
        z = bias + np.bincount(self.sentence, few[self.feature], self.document_ptr[-1])
        kept = np.exp(-_sum_by(np.logaddexp(0, z), self.document_ptr))  # prod(1 - p)
        pull = np.where(self.labels > 0, -kept / np.maximum(1 - kept, 1e-9), 1.0)
        slope = np.maximum(_sigmoid(z) * np.repeat(pull, np.diff(self.document_ptr)), -1.0)
        gradient = np.bincount(self.feature, slope[self.sentence], len(few)) + DECAY * few
        gradient[0] = 0
        return gradient, slope.sum()


def fit_weights(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Adagrad on the noisy-or likelihood; documents in the given order, so the result is repeatable.

    Texts are read twice, once to choose the features and once to keep what is left of them, so that no more than
    a group's features are held in full.
    """
    size = 1 << BITS
    weights, bias = np.zeros(size), BIAS
    seen_in, toxic_in, filled = np.zeros(size, np.int32), np.zeros(size, np.int32), []
    begins = range(0, len(texts), BATCH)
    for k in begins:
        bags = Bags(texts.slice(k, BATCH))
        if len(bags.ids):
            pairs = np.unique((bags.words.row[:, None] << BITS | bags.ids).ravel())
            y, feature = labels[k : k + BATCH], pairs & (size - 1)
            seen_in += np.bincount(feature, minlength=size)
            toxic_in += np.bincount(feature[y[pairs >> BITS] > 0], minlength=size)
            filled.append(y[np.diff(bags.document_ptr) > 0])
    rate = float((np.concatenate(filled) > 0).mean()) if filled else 0.0
    usable = np.flatnonzero(telling(seen_in, toxic_in, rate))
    place = np.zeros(size, np.int32)  # 0: not used, its weight stays 0
    place[usable] = np.arange(1, len(usable) + 1)
    few = np.zeros(len(usable) + 1)
    past, past_bias = np.full(len(few), 1e-6), 1e-6
    epochs = EPOCHS if labels.min(initial=1) != labels.max(initial=0) else 0
    groups = []
    for k in begins if epochs else ():
        bags = Bags(texts.slice(k, BATCH))
        if len(bags.ids):
            groups.append(_Group(bags, place, labels[k : k + BATCH]))
    for _ in range(epochs):
        for group in groups:
            gradient, total = group.step(few, bias)
            past += gradient**2
            few -= RATE * gradient / np.sqrt(past)
            past_bias += total**2
            bias -= RATE * total / np.sqrt(past_bias)
    weights[usable] = few[1:]
    return weights.astype(np.float32), float(bias)


def pack_model(weights: np.ndarray, bias: float) -> bytes:
    return zlib.compress(np.append(weights, np.float32(bias)).tobytes(), 1)


def held_out(id_column: str) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0 (a null id: '')."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 5 == 0


def _fitting(sized: DataFrame, max_bytes: int) -> DataFrame:
    """The rows (a bounded sample: no texts, only sizes) that fit into ``max_bytes`` in order; one that does not is passed over."""

    def run(batches):
        found = [b for b in batches if len(b)]
        if found:
            taken = pa.Table.from_batches(found).sort_by([("_order", "ascending"), ("_id", "ascending")])
            room, kept = max_bytes, []
            for size in taken["_size"].to_pylist():
                kept.append(size <= room)
                room -= size if size <= room else 0
            yield from taken.filter(pa.array(kept, pa.bool_())).combine_chunks().to_batches()

    return sized.repartition(1).mapInArrow(run, sized.schema)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    max_documents: int = MAX_FIT_DOCUMENTS,
    max_bytes: int = MAX_FIT_BYTES,
) -> bytes:
    """The model, learned from at most ``max_documents`` labelled documents outside the held-out fold.

    The sample are the documents with the smallest id hash, one row for each id; ids serve for nothing else. Of
    them, whole texts are taken in that order that fit into what is left of ``max_bytes``, and only these are gathered.
    One task learns from this bounded sample.
    """
    bounded_batches(docs.sparkSession)
    usable = docs.select(F.col(id_column).alias("_id")).filter(F.col("_id").isNotNull())
    known = (
        labels.filter(F.col(label_column).isNotNull())
        .groupBy(F.col(id_column).alias("_id"))
        .agg(F.max(label_column).cast("int").alias("_label"))
        .filter(~held_out("_id"))
        .join(usable, "_id", "left_semi")
    )
    sample = known.withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(max_documents)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    found = docs.select(F.col(id_column).alias("_id"), text.alias("_text")).join(
        F.broadcast(sample), "_id"  # bounded by max_documents
    )
    # One row for each id, that of the least text hash and length; texts are told apart by these, so that only
    # numbers are gathered to choose.
    found = found.withColumns({"_size": F.octet_length("_text").cast("long"), "_hash": F.xxhash64("_text")})
    sized = found.groupBy("_id").agg(
        F.min("_order").alias("_order"), F.min(F.struct("_hash", "_size")).alias("_least")
    ).select("_id", "_order", "_least.*")
    chosen = _fitting(sized, max_bytes)
    rows = found.join(F.broadcast(chosen), ["_id", "_hash", "_size"], "left_semi").dropDuplicates(["_id"])

    def learn(batches):
        found = [b for b in batches if len(b)]
        texts, marks = pa.array([], pa.string()), np.zeros(0, int)
        if found:
            whole = pa.Table.from_batches(found)
            taken = whole.sort_by([("_order", "ascending"), ("_id", "ascending")])
            texts, marks = taken["_text"].combine_chunks(), taken["_label"].to_numpy().astype(int)
            del found, whole, taken
        model = pack_model(*fit_weights(texts, marks))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    learned = rows.repartition(1).mapInArrow(learn, "model binary").first()
    return bytes(learned["model"]) if learned else pack_model(*fit_weights(pa.array([], pa.string()), np.zeros(0, int)))


def _parts(texts: pa.Array) -> list[pa.Array]:
    """The column in runs of rows of about SCORE_BYTES; a longer text is a run of its own."""
    ends = np.cumsum(pc.coalesce(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, first = [], 0
    while first < len(texts):
        room = SCORE_BYTES + (ends[first - 1] if first else 0)
        stop = max(first + 1, int(np.searchsorted(ends, room, "right")))
        out.append(texts.slice(first, stop - first))
        first = stop
    return out


def score(docs: DataFrame, model: bytes, text_column: str = "text", floor: float = 0.5) -> DataFrame:
    """``docs`` with toxicity, n_sentences and offending: spans (code points) of sentences of at least ``floor``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size, 2**BITS weights

    def make():
        values = np.frombuffer(zlib.decompress(shared.value), np.float32)
        weights, bias = values[:-1].astype(np.float64), float(values[-1])

        def scored(texts):
            bags = Bags(texts)
            z = bags.sentence_logits(weights, bias)
            ptr, words = bags.document_ptr, bags.words
            scores = noisy_or(z, ptr)
            spans = [[] for _ in range(len(texts))]
            bad = np.flatnonzero(z >= np.log(floor / (1 - floor)))
            if len(bad):
                chars = char_index(words.data, words.offsets)
                rows = np.searchsorted(ptr, bad, "right") - 1
                for s, row in zip(bad, rows, strict=True):
                    first = words.start[bags.sentence_ptr[s]]
                    last = words.start[bags.sentence_ptr[s + 1] - 1]
                    end = last + _word_length(words.data, last, words.offsets[row + 1])
                    base = chars[words.offsets[row]]
                    spans[row].append(
                        {"start": int(chars[first] - base), "end": int(chars[end] - base), "score": float(_sigmoid(z[s]))}
                    )
            return scores, np.diff(ptr), spans

        def compute(batch):
            parts = [scored(texts) for texts in _parts(column(batch, text_column))]
            scores, sizes, spans = zip(*parts, strict=True) if parts else ([np.zeros(0)], [np.zeros(0, int)], [[]])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            return [
                pa.array(np.concatenate(scores), pa.float64()),
                pa.array(np.concatenate(sizes), pa.int64()),
                pa.array([x for part in spans for x in part], kind),
            ]

        return compute

    return append_columns(docs, make, "toxicity double, n_sentences long, offending " + SPANS)


def _word_length(data: np.ndarray, start: int, stop: int) -> int:
    gaps = np.flatnonzero(NOT_ALNUM[data[start:stop]])
    return int(gaps[0]) if len(gaps) else int(stop - start)


def sentences(docs: DataFrame, model: bytes, text_column: str = "text", floor: float = 0.5) -> DataFrame:
    """One row per offending sentence: the columns of ``docs``, start, end, score and the sentence itself."""
    hit = fresh_name(docs, "_hit")
    marked = score(docs, model, text_column, floor).withColumn(hit, F.explode("offending"))
    return marked.select(
        *[c for c in docs.columns if c not in ("start", "end", "score", "sentence")],
        F.col(hit)["start"].alias("start"),
        F.col(hit)["end"].alias("end"),
        F.col(hit)["score"].alias("score"),
        F.substring(F.col(text_column), F.col(hit)["start"] + 1, F.col(hit)["end"] - F.col(hit)["start"]).alias("sentence"),
    )
