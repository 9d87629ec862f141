"""Properties on generated inputs, and the shape of plans."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkspan.functions.ranking import with_position
from inkspan.operators import classify, entities, names, selection, similarity
from inkspan.plans import registry
from inkspan.plans.fixtures import Corpus
from inkspan.plans.names import search_docs

FOLDER = "/root/testdata/sf0.001"
few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(texts=st.lists(st.text(alphabet="010203-1234 +45xXæé😀.", max_size=60), min_size=1, max_size=8))
def test_offsets_point_at_the_occurrence(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in entities.mentions(df).collect():
        assert texts[r.doc_id][r.start : r.end] == r.occurrence


@few
@given(labels=st.lists(st.sampled_from("aab"), min_size=1, max_size=60), folds=st.integers(2, 5))
def test_folds_are_even_and_complete(spark, labels, folds):
    df = spark.createDataFrame([(i * 3, x) for i, x in enumerate(labels)], "doc_id long, label string")
    rows = selection.stratified_folds(df, folds).collect()
    assert sorted(r.doc_id for r in rows) == [i * 3 for i in range(len(labels))]
    for label in set(labels):
        sizes = [sum(r.label == label and r.fold == f for r in rows) for f in range(1, folds + 1)]
        assert max(sizes) - min(sizes) <= 1


@few
@given(ids=st.sets(st.integers(-50, 5000), min_size=1, max_size=50))
def test_positions_equal_row_numbers(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = with_position(df, [], [F.col("doc_id")]).orderBy("doc_id").collect()
    assert [(r.doc_id, r.position) for r in got] == [(x, n) for n, x in enumerate(sorted(ids), 1)]


@few
@given(scores=st.dictionaries(st.sampled_from("abcd"), st.floats(-50, 50), min_size=1))
def test_probabilities_sum_to_one(spark, scores):
    df = spark.createDataFrame([(scores,)], "s map<string,double>")
    p = df.select(classify.softmax(F.col("s"))).first()[0]
    assert abs(sum(p.values()) - 1) < 1e-9


@few
@given(
    texts=st.lists(st.text(alphabet="ab c", min_size=0, max_size=30), min_size=1, max_size=8),
    name=st.sampled_from(["a b", "ab c", "b b", "a c b"]),
    slop=st.integers(0, 2),
)
def test_phrases_equal_brute_force(spark, texts, name, slop):
    docs = spark.createDataFrame([(i, 0, "en", t, "") for i, t in enumerate(texts)], "doc_id long, company_id long, lang string, text string, name string")
    people = spark.createDataFrame([(0, 0, name, 1)], "person_id long, company_id long, name string, relation int")
    found = {r.doc_id for r in names.exact_name_matches(docs, people, slop).collect()}
    parts = name.split()
    if len(parts) - 2 <= slop:
        parts, allowed = [parts[0], parts[-1]], slop
    else:
        allowed = 0

    def occurs(words):
        spots = [[i for i, w in enumerate(words) if w == p] for p in parts]

        def search(k, used, adj):
            if k == len(parts):
                return max(adj) - min(adj) <= allowed
            return any(search(k + 1, used | {i}, adj + [i - k]) for i in spots[k] if i not in used)

        return search(0, frozenset(), [])

    assert found == {i for i, t in enumerate(texts) if occurs(t.split())}


def test_slop_is_monotone(spark):
    c = Corpus(spark, FOLDER)
    docs, people = search_docs(c), c.people()
    found = [
        {tuple(r) for r in names.exact_name_matches(docs, people, s).select("person_id", "doc_id").collect()}
        for s in (0, 1, 2)
    ]
    assert found[0] <= found[1] <= found[2]
    partial = {tuple(r) for r in names.partial_name_matches(docs, people).collect()}
    assert found[0] <= partial


def test_a_group_of_copies_costs_one_link_per_copy(spark):
    rows = [(i, "one two three four five six") for i in range(400)] + [(1000, "one two three four five seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = similarity.similar_documents(docs).collect()
    assert sum(r.is_copy for r in out) == 399 and len(out) == 401 and {r.class_id for r in out} == {0}
    assert similarity.similar_links(similarity.distinct_texts(docs)[1]).count() == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["exact_name_match", "partial_name_match", "keyword_match", "high_risk_partial", "document_index"])
def test_no_cross_joins(spark, key):
    plan = _plan(registry.QUERIES[key](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key", ["find_national_ids", "admit_documents", "merge_hits", "document_index", "detect_language", "extract_text"])
def test_no_python_in_the_plan(spark, key):
    assert not re.search(r"Python|InPandas|InArrow", _plan(registry.QUERIES[key](spark, FOLDER)))


def test_columns_are_pruned(spark):
    plan = _plan(registry.QUERIES["relevant_files"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan
