"""Rare words with evidence count, however many documents are labelled."""

import numpy as np
import pyarrow as pa
import pytest

from inkspan.llm.toxicity import Bags, fit_weights, noisy_or


@pytest.mark.parametrize("count", [2000, 8000])
def test_rare_offending_words_are_learned(count):
    rng = np.random.default_rng(3)
    clean = np.array(["".join(x) for x in rng.choice(list("abcdefghij"), (2000, 6))])
    bad = np.array(["".join(x) for x in rng.choice(list("pqrstuvwxy"), (30, 8))])

    def make(n, toxic):
        out = []
        for y in toxic:
            words = list(rng.choice(clean, 60))
            if y:
                words[7], words[31] = rng.choice(bad, 2, replace=False)
            out.append(" ".join(words[:30]) + ". " + " ".join(words[30:]) + ".")
        return out

    labels = np.zeros(count, int)
    labels[rng.choice(count, 150, replace=False)] = 1  # about ten documents for each word
    weights, bias = fit_weights(pa.array(make(count, labels)), labels)
    marks = np.repeat([1, 0], 200)
    bags = Bags(pa.array(make(400, marks)))
    found = noisy_or(bags.sentence_logits(weights.astype(float), bias), bags.document_ptr) >= 0.5
    assert found[:200].mean() >= 0.75
    assert found[200:].mean() <= 0.02
