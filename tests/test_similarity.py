"""The set-similarity join against all pairs, its cost on families of copies, and connected components."""

import random
import re
from itertools import combinations

import pytest

from inkspan.operators import components, similarity


def sets_of(rows):
    out = {}
    for i, text in rows:
        words = re.findall(r"\w+", (text or "").lower())
        out[i] = {tuple(words[k : k + 3]) for k in range(len(words) - 2)} or {tuple(words)}
    return out


def plain_classes(rows, threshold):
    sets, part = sets_of(rows), {i: i for i, _ in rows}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-12:
            x, y = sorted((top(a), top(b)))
            part[y] = x
    return {i: top(i) for i in part}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    out = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([2, 6, 14, 40]))
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 2)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 2)] = rng.choices(words, k=rng.randint(0, 2))
                own = own or ["w0"]
            out.append(" ".join(own))
    out += ["", None, "!!", "one", "One.", "one two", out[0], out[5], " ".join(words * 3), " ".join(words * 2)]
    rng.shuffle(out)
    return [(3 * k + 1, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_classes_are_those_of_all_pairs(spark, rows, threshold):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in similarity.similar_documents(docs, threshold=threshold).collect()}
    assert got == plain_classes(rows, threshold)


def test_links_are_verified(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = sets_of(rows)
    for r in similarity.similar_links(similarity.distinct_texts(docs)[1], 0.5).collect():
        both = len(sets[r.a] & sets[r.b])
        assert r.a > r.b and r.jaccard == pytest.approx(both / len(sets[r.a] | sets[r.b])) and r.jaccard >= 0.5


def test_a_family_of_near_copies_is_compared_with_its_first(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"t{k}" for k in range(40)]
    rows = []
    for k in range(300):
        own = list(base)
        own[rng.randrange(40)] = f"x{k}"
        rows.append((k, " ".join(own)))
    seen, real = [], similarity._verified
    monkeypatch.setattr(similarity, "_verified", lambda pairs, *rest: (seen.append(pairs.count()), real(pairs, *rest))[1])
    got = similarity.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.class_id for r in got.collect()} == {0}
    assert sum(seen) < 300 * 40 / 4  # all pairs would be 44,850


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similarity.similar_documents(docs).count() == 0


def test_components(spark):
    path = [(k + 1, k) for k in range(70)]
    star = [(500, 501 + k) for k in range(30)] + [(530, 400)]
    rng = random.Random(2)
    loose = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(7000, 7000)]
    links = path + star + loose
    part = {x: x for link in links for x in link}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        part[y] = x
    got = {r["node"]: r["class"] for r in components.classes(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in part if x != 7000}
    assert components.classes(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_are_made_distinct_where_their_text_is(spark):
    """Texts are dealt by document; neither their shingles nor, for the choice of texts, the texts are shuffled once more."""
    docs = spark.createDataFrame([(k, f"a b c d{k % 5} e f") for k in range(20)], "doc_id long, text string")
    _, texts = similarity.distinct_texts(docs)
    plan = similarity.shingle_rows(texts)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange" in x]
    assert sum("REPARTITION_BY_NUM" in x for x in dealt) == 1 and not any("shingle" in x for x in dealt) and "LeftSemi" not in plan
    got = {(r.doc_id, r.shingle) for r in similarity.shingle_rows(texts).collect()}
    assert len(got) == 5 * 4 and {d for d, _ in got} == set(range(5))
