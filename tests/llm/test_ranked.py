"""Ranked search against a plain scan, its bounds, and defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkspan.llm import ranked


def terms_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, top=10):
    counts = [(doc, Counter(terms_of(t))) for doc, t in docs]
    counts = [(doc, c) for doc, c in counts if c]
    number, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c in counts:
            m = 10 + 90 * sum(c.values()) * number // total
            score = sum(
                math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms if t in c
            )
            scored += [(-score, doc is not None, doc or 0, doc)] if score > 0 else []
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return Counter(out)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(150)] + ["Né", "É", "x9", "😀"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 60, 400])))) for k in range(300)]
    docs += [(1000 + k, docs[7][1]) for k in range(80)]  # a large group of copies
    docs += [(2000 + k, docs[7][1] + " w1") for k in range(40)]
    docs += [(None, "w3 w4"), (None, "w140 x9"), (5, docs[5][1]), (6, "w149"), (9000, None), (9001, ""), (9002, "-- !!")]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 8, 30])))) for k in range(25)]
    items += [(50, docs[7][1]), (None, "W3, w5!"), (3, "w100"), (60, None), (61, "nowhere"), (62, "né")]
    return docs, items


def _run(spark, tables, **how):
    docs = spark.createDataFrame([(*r, 1, "t") for r in tables[0]], "doc_id long, text string, score int, tag string")
    items = spark.createDataFrame([(*r, 1) for r in tables[1]], "item_id long, text string, doc int")
    found = ranked.search(docs.repartition(4), items, **how)
    rows = found.select(ranked.plain_id("item").alias("i"), "rank", ranked.plain_id("doc").alias("d"), "score").collect()
    return Counter(tuple(r) for r in rows)


def test_equal_to_a_plain_scan(spark, tables):
    assert _run(spark, tables) == plain(*tables)


def test_loose_bounds_lose_nothing(spark, tables):
    # Few coordinates, so that nearly every bound is too high, and several blocks of queries.
    assert _run(spark, tables, block_terms=100, top=3, width=4, first=11) == plain(*tables, top=3)


def test_bounds_are_not_below_the_scores():
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(f"t{x}" for x in rng.zipf(1.3, size)) for size in (3, 50, 5_000)])
    row, term, tf, total = ranked._counted(texts)
    m = ranked.length_factor(total, 3, int(total.sum()))
    asked = np.unique(term[row == 1])
    block = ranked.Block(np.zeros(len(asked), np.int64), asked, np.arange(1, len(asked) + 1), 64)
    spot = ranked._place(term, 64)
    order = np.argsort(tf)  # the largest of a coordinate is written last
    ((_, bounds),) = block.bounds(row[order], spot[order], ranked.impact(tf, m[row])[order], 3)
    for k in range(3):
        own = dict(zip(term[row == k].tolist(), ranked.impact(tf, m[row])[row == k].tolist(), strict=True))
        score = sum(int(w) * own.get(int(t), 0) for t, w in zip(block.term, block.weight, strict=True))
        assert score <= bounds[k]


def test_few_pairs_are_rescored(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choices([f"v{j}" for j in range(3000)], k=80))) for k in range(3000)]
    items = [(k, " ".join(docs[k * 50][1].split()[:25])) for k in range(20)]
    seen = []
    real = ranked.rescored
    monkeypatch.setattr(ranked, "rescored", lambda t, pairs, *rest: (seen.append(pairs.count()), real(t, pairs, *rest))[1])
    assert _run(spark, (docs, items)) == plain(docs, items)
    sharing = sum(bool({*t.split()} & {*i.split()}) for _, t in docs for _, i in items)
    assert sum(seen) < sharing / 10


def test_empty(spark, tables):
    docs, items = tables
    none = spark.createDataFrame([(1, "")], "doc_id long, text string")
    some = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    for left, right in [(none, asked), (none.limit(0), asked), (some, asked.limit(0)), (some, asked.filter(F.col("item_id") == 60))]:
        assert ranked.search(left, right).count() == 0
    long = spark.createDataFrame([(1, "lorem ipsum " * 40_000), (2, "dolor")], "doc_id long, text string")
    one = spark.createDataFrame([(1, "ipsum")], "item_id long, text string")
    assert [r.doc for r in ranked.search(long, one).collect()] == [1]
