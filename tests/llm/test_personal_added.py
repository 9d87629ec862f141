"""Precision and recall of added spans on planted data, by kind, and redaction."""

import pickle
import random
from collections import Counter

import pytest

from inkspan.llm import personal

FILLER = "the report of last week was read by many people and nobody had a question about it".split()


def words(rng, n):
    return " ".join(rng.choices(FILLER, k=n))


def phone(rng, plus):
    return f"{'+' if plus else ''}{rng.randrange(1, 99)} ({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"


def mail(rng, spelt):
    name, host = f"user{rng.randrange(999)}", f"host{rng.randrange(99)}"
    return f"{name} [at] {host} [dot] org" if spelt else f"{name}@{host}.org"


@pytest.fixture(scope="module")
def planted(spark):
    """Base data to learn from; shapes that no base rule takes; and numbers that are no personal data."""
    rng = random.Random(12)
    rows, wanted = [], {}
    for k in range(1500):
        known = [f"call {phone(rng, True)}", f"write to {mail(rng, False)}", f"server 10.{rng.randrange(256)}.{rng.randrange(256)}.7"]
        noise = [
            f"order {rng.randrange(10**8, 10**9)} pieces", f"version 1.{rng.randrange(300, 999)}.{rng.randrange(300, 999)}.{rng.randrange(999)}",
            f"sum {rng.randrange(100, 999)} {rng.randrange(100, 999)} {rng.randrange(100, 999)} kroner", f"meet at noon dot {k}",
        ]
        rows.append((k, f"{words(rng, 6)} {rng.choice(known)} {words(rng, 5)} {rng.choice(noise)} {words(rng, 3)}"))
    for k in range(2000, 2300):
        kind = rng.choice(["phone", "email", None])
        new = {"phone": f"call {phone(rng, False)}", "email": f"write to {mail(rng, True)}", None: f"order {rng.randrange(10**8, 10**9)} pieces"}[kind]
        head = words(rng, 6) + " "
        rows.append((k, f"{head}{new} {words(rng, 5)}"))
        if kind:
            wanted[k] = (kind, new.split(" ", 1 if kind == "phone" else 2)[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, wanted, personal.fit(docs.filter("doc_id < 2000"))


def test_added_spans_by_kind(planted):
    docs, wanted, model = planted
    found = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.personal if not s.base] for r in personal.detect(docs.filter("doc_id >= 2000"), model).collect()}
    right, added, there = Counter(), Counter(), Counter(k for k, _ in wanted.values())
    for doc, spans in found.items():
        for kind, text in spans:
            added[kind] += 1
            right[kind] += wanted.get(doc, (None, ""))[0] == kind and text in wanted[doc][1]
    figures = {k: (round(right[k] / max(1, added[k]), 2), round(right[k] / there[k], 2)) for k in there}
    print(figures, pickle.loads(model).thresholds)
    assert all(precision >= 0.9 and recall >= 0.8 for precision, recall in figures.values())
    assert added["ip"] + added["card"] <= 0.05 * len(found)


def test_redaction(planted, make):
    docs, _, model = planted
    rows = [(1, "mail jane@host.org or +45 (123) 456-7890 now", "c"), (2, None, "c"), (3, "nothing here", "c"), (4, "", "c")]
    out = {r.doc_id: r for r in personal.redact(make(rows, "doc_id long, text string, _clean string"), model).collect()}
    assert out[1].text == "mail [email] or [phone] now" and [s.kind for s in out[1].personal] == ["email", "phone"]
    assert [out[k].text for k in (2, 3, 4)] == [None, "nothing here", ""] and all(r["_clean"] == "c" for r in out.values())
    assert personal.redact(docs.limit(0), model).count() == 0
