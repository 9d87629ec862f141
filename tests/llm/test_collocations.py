"""Collocations against a plain count, colliding fingerprints, and defined cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkspan.llm import collocations as col


def plain(rows, longest=3, least=10, covered=50, top=2000):
    seen, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for k in range(len(words) - n + 1):
                    seen[lang, tuple(words[k : k + n])] += 1
    out = []
    found = {key: a for key, a in seen.items() if len(key[1]) > 1 and a >= least}
    for (lang, words), a in found.items():
        cuts = [(seen[lang, words[:k]], seen[lang, words[k:]]) for k in range(1, len(words))]
        score, k = min((10**6 * a * a // (x * y), k) for k, (x, y) in enumerate(cuts))
        inside = [
            b for (other, more), b in found.items()
            if other == lang and len(more) > len(words)
            and any(more[i : i + len(words)] == words for i in range(len(more) - len(words) + 1))
        ]
        if not any(100 * b >= covered * a for b in inside):
            out.append((lang, -score, -a, " ".join(words).encode(), *cuts[k], totals[lang]))
    out.sort()
    rank, result = Counter(), []
    for lang, score, a, phrase, x, y, n in out:
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], phrase.decode(), -a, x, y, n, -score))
    return sorted(result)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    kinds = ["Alpha", "beta", "né", "d'or", "(e)", "f\x0bg", "🙂", "x" * 40]
    ends = [" ", "  ", "\t", ". ", ",", "\n", " ! "]
    out = []
    for k in range(300):
        text = "".join(rng.choice(kinds[: 3 + k % 6]) + rng.choice(ends[: 2 + k % 6]) for _ in range(k % 40))
        out.append((rng.choice(["en", None, "und", "fr", ""]), text))
    return [*out, ("en", None), ("en", ""), ("zz", "one two three"), ("xx", "far out " * 12)]


def _run(spark, rows, bits=64, **how):
    docs = spark.createDataFrame([(k % 250, *r, 1, "s") for k, r in enumerate(rows)], "doc_id long, lang string, text string, size int, phrase string")
    # Documents 0 to 53 repeat an id with other texts and languages.
    found = col.frequent_phrases(docs.repartition(5), bits=bits, longest=how.get("longest", 3))
    return sorted(tuple(r) for r in col.collocations(found, top=how.get("top", 2000)).collect())


@pytest.mark.parametrize("bits", [64, 14, 6])
def test_equal_to_a_plain_count_whatever_collides(spark, rows, bits):
    assert _run(spark, rows, bits) == plain(rows)


def test_longer_phrases_and_a_short_list(spark, rows):
    assert _run(spark, rows, longest=4, top=5) == plain(rows, longest=4, top=5)


def test_words_across_chunks(monkeypatch):
    texts = pa.array(["ab cde  fghij.k" * 9, None, "", "x" * 50 + " y", "ab"])
    whole = col.Words(texts)
    monkeypatch.setattr(col, "CHUNK", 7)
    parts = col.Words(texts)
    assert np.array_equal(whole.hash, parts.hash) and np.array_equal(whole.check, parts.check)
    assert whole.hash[0] == whole.hash[-1] and len({*whole.hash[:3].tolist()}) == 3


def test_the_hash_of_the_bit_table_is_that_of_spark(spark):
    values = np.array([0, 1, -1, 2**63 - 1, -(2**63), 12345678901], np.int64)
    frame = spark.createDataFrame([(int(v),) for v in values], "v long").selectExpr("v", "xxhash64(v) h")
    want = {r.v: r.h for r in frame.collect()}
    assert col._xxhash64(values.view(np.uint64)).view(np.int64).tolist() == [want[int(v)] for v in values]


def test_products_beyond_64_bits(spark):
    big = 9 * 10**12
    rows = [("en", 0, "", 10**13), ("en", 1, "a", big + 1), ("en", 1, "b", big), ("en", 2, "a b", big - 1)]
    phrases = spark.createDataFrame(rows, "lang string, size int, phrase string, f long")
    (only,) = col.collocations(phrases).collect()
    assert only.score == 10**6 * (big - 1) ** 2 // ((big + 1) * big)


def test_empty_and_long(spark, rows):
    docs = spark.createDataFrame([(None, None, None)], "doc_id long, lang string, text string")
    assert _run(spark, [("en", "lorem ipsum dolor " * 30_000)]) == plain([("en", "lorem ipsum dolor " * 30_000)])
    assert col.collocations(col.frequent_phrases(docs)).count() == 0
    assert col.collocations(col.frequent_phrases(docs.limit(0))).count() == 0
