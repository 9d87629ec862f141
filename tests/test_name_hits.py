"""Hits of people are made where their document is: they grow with people times documents and are never shuffled."""

import re

import pytest

from inkspan.operators import names, risk
from inkspan.plans import registry

FOLDER = "/root/testdata/sf0.001"
DOCS = [(0, 0, "en", "anna hansen risk", "t"), (1, 0, "en", "hansen anna", "t"), (2, 0, "en", "bo hansen", "anna"), (3, 1, "en", "anna hansen", "t")]
PEOPLE = [(i, 0, "Anna Hansen", 1) for i in range(5)] + [(5, 0, "Bo Hansen", 2), (6, 1, "anna hansen", 1), (6, 1, "anna hansen", 1), (7, 0, None, 1)]


def _tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, company_id long, lang string, text string, name string")
    people = spark.createDataFrame(PEOPLE, "person_id long, company_id long, name string, relation int")
    return docs, people


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _above_shuffles(df):
    """What the plan does after its last shuffle."""
    lines = _plan(df).split("\n")
    return "\n".join(lines[: next(i for i, line in enumerate(lines) if "- Exchange" in line)])


@pytest.mark.parametrize("key", ["exact_name_match", "swapped_name_match", "partial_name_match", "match_range"])
def test_pairs_of_person_and_document_are_not_shuffled(spark, key):
    assert "BroadcastHashJoin" in _above_shuffles(registry.QUERIES[key](spark, FOLDER))


@pytest.mark.parametrize("key", ["merge_hits", "risk_documents"])
def test_merged_hits_are_not_shuffled(spark, key):
    above = _above_shuffles(registry.QUERIES[key](spark, FOLDER))
    assert "Union" in above and "BroadcastHashJoin" in above


def test_documents_are_dealt_by_pairs_of_person_and_document(spark, monkeypatch):
    """Ten times the people and documents are a hundred times the hits, so a task has to get fewer documents."""
    docs, people = _tables(spark)
    assert names.document_parts(docs, people) == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = sorted(tuple(r) for r in registry.QUERIES["risk_level"](spark, FOLDER).collect())
    monkeypatch.setattr(names, "PAIRS_AT_ONCE", 12)
    assert names.document_parts(docs.crossJoin(spark.range(100)), people) == 300
    merged = registry.QUERIES["merge_hits"](spark, FOLDER)
    parts = re.findall(r"hashpartitioning\(doc_id#\d+L?, (\d+)\)", _plan(merged))
    assert parts and {int(n) for n in parts[:1]} != {4 * 8} and "Union" in _above_shuffles(merged)
    assert sorted(tuple(r) for r in registry.QUERIES["risk_level"](spark, FOLDER).collect()) == few


def test_near_words_are_paired_in_the_text(spark):
    """No probe for every person and occurrence: the pairs come from a window over the words of a text."""
    assert "Window" in _plan(registry.QUERIES["swapped_name_match"](spark, FOLDER))


@pytest.mark.parametrize("at_once", [2, 200_000])
def test_people_in_parts(spark, monkeypatch, at_once):
    monkeypatch.setattr(names, "PEOPLE_AT_ONCE", at_once)
    docs, people = _tables(spark)
    exact = sorted(tuple(r) for r in names.exact_name_matches(docs, people, 1).collect())
    assert exact == sorted([(i, 0) for i in range(5)] + [(5, 2), (6, 3)])
    swapped = sorted(tuple(r) for r in names.exact_name_matches(docs, people, 2).collect())
    assert swapped == sorted([(i, d) for i in range(5) for d in (0, 1)] + [(5, 2), (6, 3)])
    partial = sorted(tuple(r) for r in names.partial_name_matches(docs, people).collect())
    assert partial == sorted([(i, d) for i in range(5) for d in (0, 1, 2)] + [(5, 0), (5, 1), (5, 2), (6, 3)])
    ranged = names.match_ranges(docs, people)
    spans = sorted((r.person_id, r.doc_id, r.start, r.end) for r in ranged.collect())
    want = [(i, 0, 0, 4) for i in range(5)] + [(i, d, 5, 11) for i in range(5) for d in (1, 2)]
    assert spans == sorted(want + [(5, 0, 3, 9), (5, 1, 3, 9), (5, 2, 0, 2), (6, 3, 0, 4), (6, 3, 0, 4)])
    keywords = spark.createDataFrame([(0, "risk")], "doc_id long, keyword string")
    assert names.high_risk_partial(ranged, keywords).count() == 6


def test_keywords_are_counted_once(spark):
    rows = [(1, "exact_high", "A", "x"), (1, "partial_high", "A", "x"), (1, "exact_high", "B", "y"), (1, "exact_high", "B", None)]
    merged = spark.createDataFrame([(*r, "high") for r in rows], "doc_id long, kind string, person_name string, keyword string, risk string")
    found = risk.risk_documents(merged).first()
    assert (found.n_hits, found.n_names, found.n_keywords, found.n_exact_high) == (4, 2, 2, 3)


def _shuffled_rows(df):
    """Rows written by the shuffles of a plan that is run here."""
    df._jdf.queryExecution().toRdd().count()

    def walk(plan):
        kind = plan.nodeName()
        if kind == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStage"):
            return walk(plan.plan())
        inner = plan.children()
        below = sum(walk(inner.apply(i)) for i in range(inner.size()))
        return below + (plan.metrics().apply("shuffleRecordsWritten").value() if kind == "Exchange" else 0)

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_search_shuffles_the_words_it_needs_of_shared_positions(spark):
    """The positions serve all searches of the merge; a search for a few words does not shuffle those of the others."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "id % 3 AS company_id", "'en' AS lang", "concat('anna of hansen w', id % 7) AS text", "'risk' AS name")
    words = spark.createDataFrame([(w,) for w in ["anna", "of", "hansen", "risk"]], "token string")
    positions = names.search_positions(docs, [words])
    people = spark.createDataFrame([(1, 0, "Anna Hansen", 1), (2, 0, "Risk", 1), (3, 0, "Hansen of Risk", 1)], "person_id long, company_id long, name string, relation int")
    keywords = spark.createDataFrame([("en", "hansen"), ("en", "no such word")], "lang string, keyword string")
    found = names.keyword_matches(docs, keywords, positions)
    assert sorted(tuple(r) for r in found.collect()) == [(i, "hansen") for i in range(2000)]
    assert _shuffled_rows(found) < 3 * 2000 + 100  # positions are 8000, and there are three joins and aggregates
    common = names.common_name_matches(docs, spark.createDataFrame([("Anna",)], "common_name string"), positions)
    assert common.count() == 2000 and _shuffled_rows(common) <= 2 * 2000
    assert sorted(tuple(r) for r in names.exact_name_matches(docs, people, 1, positions).collect()) == sorted((p, d) for p in (1, 2) for d in range(0, 2000, 3))
    pairs = names.exact_name_matches(docs, people.filter("person_id = 1"), 1, positions)
    assert pairs.count() == 667 and _shuffled_rows(pairs) < 4 * 667 + 100


def test_names_and_keywords_are_counted_without_a_set(spark):
    """A set of keywords makes Spark sort all hits; the counts are those of plain sets, nulls left out."""
    rows = [
        (1, "exact_high", "anna", "fire", 1, None, None), (1, "exact_high", "anna", "fire", 2, None, None),
        (1, "partial_high", "anna", "theft", 1, 0, 4), (1, "partial_high", "bo", "theft", 1, 0, 2),
        (1, "exact_high", "anna", "fire", 1, None, None), (2, "exact_low", "anna", None, 1, None, None),
        (2, "partial_low", None, None, 1, None, None), (3, "common_low", "eva", None, None, None, None), (None, "exact_high", "fire", "fire", 1, None, None),
    ]
    schema = "doc_id long, kind string, person_name string, keyword string, relation int, start int, end int"
    merged = risk.merge_hits(spark.createDataFrame(rows, schema), spark.createDataFrame([(2,), (2,), (4,)], "doc_id long"))
    full = risk.risk_documents(merged)
    assert "ObjectHashAggregate" not in full._jdf.queryExecution().executedPlan().toString()
    found = {(r.doc_id, r.risk): (r.n_hits, r.n_names, r.n_keywords, r.n_exact_high, r.n_partial_high, r.n_exact_low, r.n_national_id) for r in full.collect()}
    assert found == {
        (1, "high"): (4, 2, 2, 2, 2, 0, 0), (2, "high"): (3, 1, 0, 0, 0, 1, 1), (3, "low"): (1, 1, 0, 0, 0, 0, 0),
        (4, "high"): (1, 0, 0, 0, 0, 0, 1), (None, "high"): (1, 1, 1, 1, 0, 0, 0),
    }
    short = risk.risk_documents(merged, distinct=False)
    assert set(full.columns) - set(short.columns) == {"n_names", "n_keywords"}
    assert {tuple(r) for r in short.collect()} == {tuple(r) for r in full.select(*short.columns).collect()}
