"""Scores against a plain noisy-or over the fitted weights."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa

from inkspan.llm import toxicity
from inkspan.llm.frames import table


def plain_score(text, weights, bias):
    out = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", sentence)
        if words:
            z = bias + sum(float(weights[toxicity.Bags(pa.array([w])).ids[0]].sum()) for w in words)
            out *= 1 - 1 / (1 + math.exp(-z))
    return 1 - out


def test_scores_are_the_noisy_or(spark, make, folder):
    rng = np.random.default_rng(4)
    texts = [". ".join(" ".join(rng.choice(["some", "plain", "words", "né"], 5)) for _ in range(4)) for _ in range(300)]
    texts = [t + " vile horrid!" if k % 4 == 0 else t for k, t in enumerate(texts)]
    known = make(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(known, make([(k, int(k % 4 == 0)) for k in range(300)], "doc_id long, toxic int"))
    docs = known.limit(40).union(table(spark, folder, "documents").select("doc_id", "text").limit(40))
    values = np.frombuffer(zlib.decompress(model), np.float32)
    weights, bias = values[:-1].astype(np.float64), float(values[-1])
    assert np.count_nonzero(weights)
    for r in toxicity.score(docs, model).collect():
        assert math.isclose(r.toxicity, plain_score(r.text, weights, bias), rel_tol=1e-6, abs_tol=1e-9)


def test_scoring_in_parts_changes_nothing(spark, make, monkeypatch):
    texts = pa.array(["a b. c", None, "", "x " * 5000, "y"] * 40)
    parts = toxicity._parts(texts)
    assert sum(map(len, parts)) == len(texts)
    monkeypatch.setattr(toxicity, "SCORE_BYTES", 7_000)
    small = toxicity._parts(texts)
    assert len(small) > 20 and pa.chunked_array(small).to_pylist() == texts.to_pylist()
