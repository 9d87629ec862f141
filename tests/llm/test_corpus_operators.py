"""The operators over the whole corpus against plain versions, and their defined cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import compare, duck

from inkspan.llm import components as comp
from inkspan.llm import decontaminate, metric_join, minhash, queries, repeats, warc

ODD = "id long, body string, doc_id string, n int, text string, kept int"


@pytest.fixture(scope="module")
def odd(make, odd_texts):
    return make([(i, t, "a", 1, "b", 1) for i, t in odd_texts], ODD)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_query_against_sql(spark, folder, key):
    assert compare(queries.QUERIES[key](spark, folder), queries.ORACLE[key], duck(folder)) is None


@pytest.mark.parametrize("n", [2, 3, 60])
def test_components_of_a_path_and_a_star(make, n):
    path = make([(k, k + 1) for k in range(n)], "a long, b long")
    star = make([(1_000, 1_001 + k) for k in range(n)] + [(5_000, 5_000)], "a long, b long")
    found = {r.node: r.component for r in comp.components(path.union(star)).collect()}
    assert found == {**{k: 0 for k in range(n + 1)}, **{1_000 + k: 1_000 for k in range(n + 1)}}
    assert comp.components(path.limit(0)).count() == 0


# --- decontamination


def distance(pattern, text, anchored=False):
    row, out = list(range(len(pattern) + 1)), []
    for k, c in enumerate(text):
        new = [k + 1 if anchored else 0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        out.append(row[-1])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=90), st.lists(st.integers(0, 3), max_size=30), st.booleans())
def test_myers_is_edit_distance(pattern, text, anchored):
    assert decontaminate.myers(pattern, text, anchored) == distance(pattern, text, anchored)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_decontaminate_finds_all_edited_items(spark, make):
    rng = random.Random(7)
    noun = [f"word{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(noun, k=n))) for k, n in enumerate([1, 3, 6, 7, 14, 20, 38, 59])]
    docs = []
    for k in range(160):
        own = rng.choices(noun, k=rng.randint(0, 120))
        if k % 2:
            item = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 10)):
                at = rng.randrange(len(item) + 1)
                item[at : at + rng.randint(0, 1)] = rng.choices(noun, k=rng.randint(0, 1))
            own[len(own) // 2 : len(own) // 2] = item
        docs.append((k, ", ".join(w.title() if rng.random() < 0.1 else w for w in own)))
    wanted = {}
    for d, text in docs:
        for i, item in items:
            pattern, own = words(item), words(text)
            best = min(distance(pattern, own), default=len(pattern))
            if best <= decontaminate.budget(len(pattern), decontaminate.RATE):
                wanted[d, i] = best
    frame = make(docs, "doc_id long, text string")
    found = decontaminate.links(frame, make(items, "item_id long, text string")).collect()
    assert {(r.doc, r.item): r.distance for r in found} == wanted and len(wanted) > 40
    texts = dict(docs)
    for r in found:
        own = words(texts[r.doc][r.start : r.end])
        assert distance(words(dict(items)[r.item]), own, True)[-1] == r.distance
    kept = {r.doc_id for r in decontaminate.clean(frame, make(items, "item_id long, text string")).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in wanted}


def test_decontaminate_query_by_brute_force(spark, folder):
    found = queries.QUERIES["op2_decontaminate"](spark, folder).collect()
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet").collect()
    wanted = {}
    for item in read("benchmark"):
        pattern = words(item.text)
        for doc in read("documents"):
            own = words(doc.text)
            edits = int(decontaminate.budget(len(pattern), decontaminate.RATE))
            if sum(w not in set(own) for w in pattern) <= edits:
                best = min(decontaminate.myers(pattern, own), default=99)
                if best <= edits:
                    wanted[doc.doc_id, item.item_id] = best
    assert {(r.doc_id, r.item_id): r.distance for r in found} == wanted


def test_decontaminate_defined_cases(odd, empty, make):
    items = make([(1, "same text"), (1, "same text"), (2, None), (3, "..."), (None, "né 😀 x")], "item_id long, text string")
    found = decontaminate.links(odd, items, "id", "body").collect()
    least = decontaminate.key_or_least
    assert {(r.doc if r.doc >= 0 else None, r.item if r.item >= 0 else None) for r in found} == {(4, 1), (5, 1), (None, None)}
    kept = decontaminate.clean(odd, items, "id", "body")
    assert kept.columns == odd.columns and sorted(r.id for r in kept.collect()) == [1, 2, 3, 6, 7] and least
    assert decontaminate.links(empty, items, "id", "body").count() == 0
    assert decontaminate.links(odd, items.limit(0), "id", "body").count() == 0


# --- repeats


def plain_repeats(docs, window=20):
    seen, out = {}, {}
    listed = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for i, t in docs}
    for i in sorted(listed):
        for k in range(len(listed[i]) - window + 1):
            seen.setdefault(tuple(listed[i][k : k + window]), (i, k))
    for i, own in listed.items():
        gone = set()
        for k in range(len(own) - window + 1):
            if seen[tuple(own[k : k + window])] < (i, k):
                gone |= set(range(k, k + window))
        out[i] = (len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone))
    return out


@pytest.mark.parametrize("arrow_bytes", [4 << 20, 2_000])
def test_repeats_by_brute_force(spark, make, monkeypatch, arrow_bytes):
    monkeypatch.setattr("inkspan.llm.frames.ARROW_BYTES", arrow_bytes)
    rng = random.Random(11)
    noun = [f"n{k}" for k in range(60)]
    pieces = [rng.choices(noun, k=n) for n in (15, 19, 20, 21, 30, 55)] + [["la"] * 70, ["da", "di"] * 30]
    docs = []
    for k in range(150):
        own = []
        for _ in range(rng.randint(0, 6)):
            own += rng.choice(pieces) if rng.random() < 0.6 else rng.choices(noun, k=rng.randint(1, 25))
        docs.append((k * 3, rng.choice([" ", "\n", "  "]).join(own)))
    frame = make(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(frame).collect()}
    assert got == plain_repeats(docs)
    for r in repeats.remove_repeats(frame).filter("n_removed > 0").collect():
        assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text[s.start : s.end])) for s in r.removed) == r.n_removed


def test_repeats_of_common_anchors_are_the_same(spark, make, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(25))
    docs = [(k, f"a{k} b{k % 7} {passage} c{k % 3} " + " ".join(f"x{k}y{j}" for j in range(20))) for k in range(400)]
    monkeypatch.setattr(repeats, "MOST", 10)
    frame = make(docs, "doc_id long, text string").repartition(9)
    assert repeats.repeated_anchors(repeats._keys(frame, "doc_id", "text")).filter("n > 10").count() > 0
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(frame).collect()}
    assert got == plain_repeats(docs)


def test_factors_are_copies_that_stand_earlier(make):
    rng = random.Random(5)
    noun = [f"n{k}" for k in range(300)]
    base = [rng.choices(noun, k=80) for _ in range(6)]
    docs = []
    for k in range(60):
        own = rng.choices(noun, k=rng.randint(0, 30))
        for _ in range(rng.randint(1, 3)):
            piece, at = rng.choice(base), rng.randint(0, 50)
            own += piece[at : at + rng.randint(15, 60)]  # meets others over its borders
        docs.append((k, " ".join(own)))
    listed = {i: t.split() for i, t in docs}
    covered = {i: set() for i in listed}
    for r in repeats.factors(make(docs, "doc_id long, text string").repartition(7)).collect():
        assert r.length >= 20 and (r.source, r.source_at) < (r.doc, r.at)
        assert listed[r.doc][r.at : r.at + r.length] == listed[r.source][r.source_at : r.source_at + r.length]
        covered[r.doc] |= set(range(r.at, r.at + r.length))
    assert {i: len(c) for i, c in covered.items()} == {i: n for i, (_, n, _) in plain_repeats(docs).items()}


def test_parse_is_greedy_and_minds_borders():
    pack = lambda words: b"".join(w.to_bytes(repeats.WORD, "little") for w in words)
    index, a = repeats.Index(), list(range(40))
    b = [*range(20, 40), *range(100, 112)]
    assert index.parse(1, 0, pack(a)) == [] and index.parse(2, 5, pack(b)) == [(5, 20, 1, 20)]
    # The first factor ends at word 40; the window over its border stands in document 2.
    assert index.parse(3, 0, pack([*range(5, 40), *range(100, 108)])) == [(0, 35, 1, 5), (16, 27, 2, 6)]
    assert index.parse(3, 0, pack([*range(5, 40), *range(100, 108)])) == [(0, 35, 1, 5), (16, 27, 2, 6)]


def test_repeats_defined_cases(odd, empty, make):
    rows = repeats.remove_repeats(odd, "id", "body").collect()
    assert len(rows) == 9 and len(rows[0]) == len(ODD.split(",")) + 4
    by_id = {r.id: r for r in rows}
    assert by_id[1].n_words == 0 and by_id[1].kept_text == "" and by_id[None].kept_text == "né 😀 x"
    assert by_id[6].n_words == 90_000 and by_id[6].n_removed == 90_000 - 3
    text = " ".join(f"w{k}" for k in range(30))
    same = make([(1, text), (1, text), (2, text), (2, "other"), (None, text)], "doc_id long, text string")
    gone = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in repeats.remove_repeats(same).collect())
    assert gone == [(0, 30, 0), (1, 30, 30), (1, 30, 30), (2, 1, 0), (2, 30, 30)]
    assert repeats.remove_repeats(empty, "id", "body").count() == 0


# --- near duplicates


def plain_groups(docs, size, percent=80):
    sets = {}
    for i, text in docs:
        own = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
        runs = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} or ({tuple(own)} if own else set())
        sets[i] = runs
    part = {i: i for i in sets}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                part[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def variants(rng, count, length):
    """Near copies whose similarities lie on both sides of the threshold, chains among them."""
    base = [f"v{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for k in range(count):
        own = list(rng.choice(out) if out and rng.random() < 0.5 else base)
        for _ in range(rng.randint(0, length // 14)):
            own[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        out.append(own)
    return [" ".join(o) for o in out]


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_by_brute_force(spark, make, monkeypatch, size):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "SLOT", 5)
    rng = random.Random(size)
    texts = [t for n, length in ((60, 80), (40, 30), (25, 200), (6, 6)) for t in variants(rng, n, length)]
    texts += ["A b C", "a B c", "x", "X", "", None, " \n", "one two", "one  two"] + [f"s{k} t{k} u{k}" for k in range(10)]
    docs = list(enumerate(texts, 5))
    rng.shuffle(docs)
    frame = make(docs, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(frame, shingle=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_groups(docs, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_large_group_of_copies(spark, make):
    docs = [(k, "the very same words in every one of them") for k in range(1500)] + [(k, f"d{k} e{k} f{k}") for k in range(1500, 1600)]
    got = minhash.near_duplicates(make(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.kept} == {0, *range(1500, 1600)}


def test_minhash_posterior_bounds():
    needed = minhash.least_matches(0.8)
    assert list(needed) == [32, 64, 96, 128, 160] and all(m < n * 0.8 for n, m in needed.items())
    assert minhash.least_matches(0.8, miss=0.05)[160] > needed[160] > minhash.least_matches(0.8, miss=1e-9)[160]


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 5_000), min_size=1, max_size=400), st.sets(st.integers(0, 5_000), min_size=1, max_size=400))
def test_minhash_cells_bound_what_is_shared(left, right):
    from inkspan.llm.wordhash import mix

    a, b = (mix(np.array(sorted(s), np.uint64)) for s in (left, right))
    rows = [np.frombuffer(minhash.cells_of(x), np.uint8)[None] for x in (a, b)]
    assert minhash.most_shared(*rows)[0] >= len(left & right)


def test_minhash_defined_cases(odd, empty):
    rows = minhash.near_duplicates(odd, "id", "body").collect()
    assert sorted((r.id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in rows) == [
        (0, 1, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True),
        (5, 1, 4, False), (6, 3, 6, True), (7, 1, 7, True),
    ]
    assert minhash.near_duplicates(empty, "id", "body").count() == 0


# --- vectors


def plain_links(rows, threshold=0.98):
    good = {}
    for i, vector, label in rows:
        x = None if vector is None or any(v is None for v in vector) else np.array(vector, float)
        if label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            good[i] = (x, label)
    links = {i: set() for i, _, _ in rows}
    for a, (x, la) in good.items():
        for b, (y, lb) in good.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
    part = {}
    for i in sorted(links):
        if i not in part:
            todo = [i]
            while todo:
                n = todo.pop()
                if n not in part:
                    part[n] = i
                    todo += links[n]
    return {i: (len(links[i]), part[i]) for i in links}


@pytest.mark.parametrize("block", [1024, 3])
def test_metric_join_by_brute_force(spark, make, monkeypatch, block):
    monkeypatch.setattr(metric_join, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for centre in range(12):
        c = rng.normal(size=16)
        for _ in range(12):
            rows.append([(c + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.3])).tolist(), int(centre % 3)])
    rows += [[rows[0][0], 0], [[2 * x for x in rows[0][0]], 0], [rows[0][0][:15], 0], [[0.0] * 16, 0], [None, 0], [[1.0, None], 0]]
    rows += [[[float("nan")] * 16, 0], [[float("inf")] * 16, 0], [rows[0][0], None], [[], 1], [[-0.0, 1.0], 2], [[0.0, 1.0], 2]]
    order = rng.permutation(len(rows))
    data = [(int(i), v, label) for i, (v, label) in zip(order, rows, strict=True)]
    frame = make(data, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_vectors(frame).collect()}
    assert got == plain_links(data)
    assert any(n > 0 for n, _ in got.values())


def test_metric_join_defined_cases(make):
    frame = make([(1, [1.0, 0.0], 1, "a"), (1, [1.0, 0.0], 1, "b"), (None, [1.0, 0.0], 1, "c"), (3, None, None, "d")], "vec_id long, embedding array<double>, label int, n_links string")
    rows = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in metric_join.near_vectors(frame).collect())
    assert rows == [(0, 1, 0, True), (1, 1, 0, False), (1, 1, 0, False), (3, 0, 3, True)]
    assert metric_join.near_vectors(frame.limit(0)).count() == 0


# --- web archives


def test_warc_round_trip_and_index(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 5)
    long = "<html>né\r\n\r\nWARC/1.1\r\n" + "x" * 3_000_000
    rows = [(k, f"http://www{k % 3}.example.org/p/{k % 7}", f"<p>{'page ' * 30}{k % 11}</p>", 1) for k in range(60)]
    rows += [(100, None, None, 1), (101, None, "", 1), (102, "ftp://a b.com/x y#z", long, 1), (103, "http://EXAMPLE.org:81", long, 1), (104, "short", "tiny", 1), (105, "short", "tiny", 1)]
    rows += [(7, "http://www1.example.org/p/0", rows[7][2], 1), (None, "http://n.org/", rows[3][2], 1)]
    pages = make(rows, "page_id long, url string, html string, kind int").repartition(3)
    captures = warc.write(pages, str(tmp_path / "archives"))
    index = warc.build_index(captures, 5)
    assert index[1].count() > 5
    least = {}
    for i, _, html, _ in rows:
        key = (html or "").encode()
        least[key] = min(least.get(key, 10**9), -1 if i is None else i)
    for records in (warc.read(captures).collect(), warc.lookup(pages, index).collect()):
        assert len(records) == len(rows)
        html = {i: (h or "").encode() for i, _, h, _ in rows}
        for r in records:
            own = html[r.capture if r.capture >= 0 else None]
            first = least[own] if len(own) >= 100 else None
            revisit = first is not None and first != max(r.capture, -1)
            assert (r.kind, r.payload_bytes, r.digest) == ("revisit" if revisit else "response", len(own), hashlib.sha256(own).hexdigest())
            assert bytes(r.payload) == (b"" if revisit else own)
            assert (r.refers_to if r.refers_to is None else max(r.refers_to, -1)) == (first if revisit else None)
    one = warc.lookup(make([("https://www2.example.org/p/5#f",), ("http://none.example.org/",)], "url string"), index).collect()
    assert {r.capture for r in one} == {k for k in range(60) if k % 3 == 2 and k % 7 == 5}
    for ranges in (1, 3, 1000):  # however the keys are dealt
        monkeypatch.setattr(warc, "RANGES", ranges)
        again = warc.lookup(pages, index).select("capture").collect()
        assert len(again) == len(rows)


@pytest.mark.parametrize(
    ("url", "key"),
    [("http://www.Example.org:8080/a?b", "org,example,www:8080)/a?b"), ("https://u@a.b", "b,a)/"), ("a.b?q", "b,a)/?q"), (None, ""), ("", "")],
)
def test_reversed_host_key(url, key):
    assert warc.reversed_host_key(url) == key


def test_warc_empty_table(make, tmp_path):
    pages = make([], "page_id long, url string, html string")
    captures = warc.write(pages, str(tmp_path / "none"))
    assert captures.count() == 0 and warc.lookup(pages, warc.build_index(captures)).count() == 0
    assert warc.read(captures).count() == 0


def test_decontaminate_items_with_repeated_pieces(spark, make):
    rng = random.Random(9)
    half = [f"p{k}" for k in range(5)]
    items = [(0, " ".join(half * 2 + [f"q{k}" for k in range(10)])), (1, " ".join([f"r{k}" for k in range(10)] + half * 2)), (2, "x " * 20)]
    docs = []
    for k in range(90):
        own = items[k % 3][1].split()
        for at in rng.sample(range(20), rng.randint(0, 4)):
            own[at] = f"z{at}"
        rest = [f"n{rng.randrange(99)}" for _ in range(k % 7)]
        docs.append((k, " ".join(rest + own if k % 2 else own + rest)))
    wanted = {}
    for d, text in docs:
        for i, item in items:
            best = min(distance(words(item), words(text)))
            if best <= decontaminate.budget(20, decontaminate.RATE):
                wanted[d, i] = best
    found = decontaminate.links(make(docs, "doc_id long, text string"), make(items, "item_id long, text string"))
    assert {(r.doc, r.item): r.distance for r in found.collect()} == wanted and len(wanted) > 60


def test_decontaminate_cleans_row_by_row(make):
    item = "one two three four five six seven"
    rows = [(None, "a clean row", 1), (None, f"see {item}", 2), (None, "another clean row", 3), (4, f"{item} again", 4), (4, "clean", 5), (6, None, 6)]
    docs = make([(*r, "d", "t", r[2]) for r in rows], "doc_id long, text string, n int, _doc string, _tag string, `_doc_` int")
    kept = decontaminate.clean(docs, make([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.n for r in kept.collect()) == [1, 3, 5, 6]
    assert {(r["_doc"], r["_tag"]) for r in kept.collect()} == {("d", "t")}
