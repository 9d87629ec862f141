"""Windows that share an anchor are equal only if their words are."""

import numpy as np
import pyarrow as pa

from inkspan.llm import repeats
from inkspan.llm.repeats import GRAM, WINDOW, Windows
from inkspan.llm.wordhash import BLANKS, grams, words_of


def test_windows_equal_in_half_of_their_hash_are_told_apart(spark):
    # A phrase that is the anchor of nearly all windows it begins, and very many such windows.
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(5000)])
    draws = rng.choice(words, 80_000)
    place = int(np.argmin(grams(words_of(pa.array([" ".join(draws)]), BLANKS, lower=False).hash, GRAM)))
    phrase = " ".join(draws[place : place + GRAM])
    texts = [f"{phrase} {' '.join(x)}" for x in rng.choice(words, (250_000, WINDOW - GRAM))]
    hashes = []
    for k in range(0, len(texts), 25_000):
        found = Windows(pa.array(texts[k : k + 25_000]))
        hashes.append(np.where(found.anchor == 0, found.hash >> np.uint64(32), np.uint64(1 << 40) + np.arange(len(found.hash), dtype=np.uint64) + np.uint64(k)))
    half = np.concatenate(hashes)
    order = np.argsort(half, kind="stable")
    alike = np.flatnonzero(half[order][1:] == half[order][:-1])
    assert len(alike)
    pairs = [(texts[order[k]], texts[order[k + 1]]) for k in alike]
    rows = [(i, t) for i, t in enumerate(t for pair in pairs for t in pair)]
    # Each in its own batch, so that the look-up decides.
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows), "doc_id")
    out = repeats.remove_repeats(docs).collect()
    assert [r.n_removed for r in out] == [0] * len(rows)
    again = docs.union(spark.createDataFrame([(1000, rows[0][1])], "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in repeats.remove_repeats(again).collect() if r.n_removed} == {1000: WINDOW}
