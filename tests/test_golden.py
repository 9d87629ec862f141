"""Hand-computed rows for the edges of the semantics."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.functions import names as fn
from inkspan.functions.dates import parse_mail_date
from inkspan.functions.html import html_text
from inkspan.functions.text import text_pieces, token_table
from inkspan.operators import classify, entities, features, ingest, names, records, risk, selection, views
from inkspan.operators import progress as prog
from inkspan.sources import files as src
from inkspan.sources.results import read_results, replace_results
from inkspan.sources.staging import new_path
from inkspan.streaming import jobs


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_clean_name(spark):
    given = ["John F. Kennedy", "J.R. Smith", "John F.", "O'Brien Pat", "Æ. Hansen", "John . Kennedy", "J. R."]
    want = ["John Kennedy", "Smith", "John", "'Brien Pat", "Æ Hansen", "John  Kennedy", ""]
    assert column(spark, given, fn.clean_name) == want


def test_middle_names(spark):
    given = ["Anna Maria Hansen", "Anna Hansen", "Anna", ""]
    assert column(spark, given, fn.middle_name_count) == [1, 0, 0, 0]
    assert column(spark, given, fn.without_middle_names) == ["Anna Hansen", "Anna Hansen", "Anna", ""]


def _docs(spark, texts, lang="en", name="title"):
    rows = [(i, 0, lang, t, name) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, company_id long, lang string, text string, name string")


def _people(spark, *people):
    return spark.createDataFrame([(i, 0, n, 1) for i, n in enumerate(people)], "person_id long, company_id long, name string, relation int")


TEXTS = ["Anna Hansen", "Anna X Hansen", "Anna X Y Hansen", "Hansen Anna"]


@pytest.mark.parametrize("slop, want", [(0, {0}), (1, {0, 1}), (2, {0, 1, 2, 3})])
def test_phrase_slop(spark, slop, want):
    found = names.exact_name_matches(_docs(spark, TEXTS), _people(spark, "Anna Hansen"), slop)
    assert {r.doc_id for r in found.collect()} == want


def test_phrases_of_three_words_and_repeats(spark):
    docs = _docs(spark, ["a Anna Brien O Hansen", "Anna Anna", "Anna once", "Anna O'Brien"])
    found = names.exact_name_matches(docs, _people(spark, "Anna Anna", "Anna O'Brien"), 1)
    assert {(r.person_id, r.doc_id) for r in found.collect()} == {(0, 1), (1, 3)}


def test_many_middle_names_need_the_full_name(spark):
    docs = _docs(spark, ["Anna B C Hansen", "Anna Hansen"])
    found = names.exact_name_matches(docs, _people(spark, "Anna B C Hansen"), 1)
    assert {r.doc_id for r in found.collect()} == {0}


def test_keyword_phrases_use_own_language_only(spark):
    docs = _docs(spark, ["the big risk here", "risk big"]).unionByName(
        _docs(spark, ["big risk"], "xx").withColumn("doc_id", F.lit(9).cast("long"))
    )
    words = spark.createDataFrame([("en", "Big Risk"), ("en", "Big Risk"), ("de", "risk")], "lang string, keyword string")
    assert [tuple(r) for r in names.keyword_matches(docs, words).collect()] == [(0, "Big Risk")]


def test_match_range(spark):
    docs = _docs(spark, ["see kennedy there", "stjohn"])
    people = _people(spark, "John F. Kennedy", "St.John")
    found = names.match_ranges(docs, people)
    assert "Scan" in found._jdf.queryExecution().executedPlan().toString() and "text#" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r.person_id: (r.start, r.end, r.range_ok) for r in found.collect()}
    assert rows[0] == (8, 15, True)
    assert rows[1][2] is False


def test_national_id_offsets(spark):
    texts = ["010203-1234", "æ010203-1234 x", "a 311299 - XXXX, 9010203-1234", "😀 010203-1234 og 0102031234é"]
    rows = entities.find_national_ids(_docs(spark, texts)).collect()
    assert {(r.doc_id, r.start, r.occurrence) for r in rows} == {
        (0, 0, "010203-1234"), (2, 2, "311299 - XXXX"), (3, 2, "010203-1234")
    }


def test_file_identifier(spark):
    assert column(spark, ["abc", "/a/æ.docx"], ingest.file_identifier) == ["891568578", "2635210389"]


def test_mail_date(spark):
    given = ["Tue, 3 Mar 2020 10:00:00 +0100", "3 Mar 2020 10:00:00", "Tue, 03 Mar 2020 10:00 GMT", "nonsense"]
    out = column(spark, given, lambda c: F.date_format(parse_mail_date(c), "yyyy-MM-dd HH:mm:ss"))
    assert out == ["2020-03-03 09:00:00", None, "2020-03-03 10:00:00", None]


def test_extension(spark):
    given = ["/a.b/c", "x.DOCX", "x.tar.gz.", ".profile", "a..."]
    assert column(spark, given, ingest.normalize_extension) == [None, "docx", "gz", "profile", None]


def test_admission_order(spark):
    df = spark.createDataFrame(
        [("en", 0.7, "x"), ("en", 0.9, ""), ("xx", 0.1, ""), ("en", 0.69, "x")],
        "lang string, lang_probability double, text string",
    )
    out = [r.admission for r in ingest.admit_documents(df, ["en"], 0.7).collect()]
    assert out == ["ok", "empty", "language", "probability"]


def test_risk_lists(spark):
    hits = risk.union_hits(
        {
            "exact_high": spark.createDataFrame([(1, "A")], "doc_id long, person_name string"),
            "exact_low": spark.createDataFrame([(1, "B"), (2, "B")], "doc_id long, person_name string"),
        }
    )
    ids = spark.createDataFrame([(2,), (3,)], "doc_id long")
    merged = risk.merge_hits(hits, ids)
    lists = {(r.doc_id, r.risk) for r in risk.risk_documents(merged).collect()}
    assert lists == {(1, "high"), (1, "low"), (2, "high"), (3, "high")}
    phones = spark.createDataFrame([(9, "12345678"), (3, "12345678")], "doc_id long, occurrence string")
    out = {r.doc_id: r.n_phones for r in risk.with_phones(risk.risk_documents(merged), phones).collect()}
    assert out == {1: 0, 2: 0, 3: 1}


def test_unknown_kind_fails(spark):
    bad = risk.tag(spark.createDataFrame([(1,)], "doc_id long"), "strange")
    with pytest.raises(Exception, match="unknown hit kind"):
        risk.guard_kinds(bad).collect()


def test_confidence_is_of_the_label(spark):
    df = spark.sql("SELECT 'b' AS label, map('a', 0.6D, 'b', 0.4D) AS p")
    assert df.select(classify.confidence(F.col("label"), F.col("p"))).first()[0] == 0.4


def test_descent_stops_on_a_repeat(spark):
    weights = spark.createDataFrame(
        [("en", None, "root", "A", 0, 1.0), ("en", "A", "a", "B", 0, 1.0), ("en", "B", "b", "A", 0, 1.0)],
        "language string, category_id string, classifier_id string, label string, feature_no int, weight double",
    )
    docs = spark.sql("SELECT 1L AS doc_id, 'en' AS lang, array(1.0D) AS features")
    out = classify.hierarchical_classify(docs, classify.pack_models(weights), 6).orderBy("level").collect()
    assert [r.label for r in out] == ["A", "B"]


def test_root_is_its_own_parent(spark):
    cats = spark.createDataFrame([("R", "root", None), ("A", "a", "R")], "category_id string, name string, parent_id string")
    assert {(r.category_id, r.parent, r.depth) for r in views.category_tree(cats).collect()} == {("R", "R", 0), ("A", "R", 1)}


def test_last_open_fold_is_next(spark):
    folds = spark.createDataFrame([(1,), (2,), (3,)], "fold int")
    results = spark.createDataFrame([(3, True), (2, False)], "fold int, is_done boolean")
    assert {(r.fold, r.is_next) for r in selection.pending_folds(folds, results).collect()} == {(1, False), (2, True)}


def test_html(spark):
    assert column(spark, ["<p>a &amp;lt; <b>b</b><script>x<y</script><!-- c --></p>"], html_text) == ["a &lt; b"]


def test_rename_keys(spark):
    df = spark.sql("SELECT 1 AS doc_id, named_struct('is_ok', true, 'a_list', array(named_struct('in_ner', 1))) AS doc_meta")
    camel = records.rename_keys(df, records.to_camel)
    assert camel.schema["docMeta"].dataType["aList"].dataType.elementType.names == ["inNer"]
    assert records.rename_keys(camel, records.to_snake).schema.simpleString() == df.schema.simpleString()


def test_no_custom_features(spark):
    assert features.custom_features(_docs(spark, ["x"]), None).count() == 0


def test_zip_container(spark):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("d/b.txt", "two")
    df = spark.createDataFrame([("x.zip", bytearray(box.getvalue()))], "path string, content binary")
    out = ingest.open_items(df, src.unzip, src.UNZIP_SCHEMA).collect()
    assert {(r.member, bytes(r.content)) for r in out} == {("a.txt", b"one"), ("d/b.txt", b"two")}


def test_replacing_twice_changes_nothing_and_empties_companies(spark):
    schema = "company_id long, doc_id long"
    path = new_path(spark, "test-results")
    companies = spark.createDataFrame([(1,), (2,)], "company_id long")
    replace_results(spark.createDataFrame([(1, 10), (2, 20), (3, 30)], schema), companies.union(spark.createDataFrame([(3,)], "company_id long")), path)
    new = spark.createDataFrame([(1, 11)], schema)
    for _ in range(2):
        replace_results(new, companies, path)
        got = {tuple(r) for r in read_results(spark, path, new.schema).collect()}
        assert got == {(1, 11), (3, 30)}


def test_long_texts_keep_every_token(spark):
    text = " ".join(f"w{i}" + "x" * (i % 7) for i in range(3000)) + " " + "y" * 9000 + " end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pieces = text_pieces(df, ["doc_id"], size=100).orderBy("piece_no").collect()
    assert "".join(p.piece for p in pieces) == text and len(pieces) > 100
    tokens = token_table(df, ["doc_id"], size=100).orderBy("pos").collect()
    assert [t.token for t in tokens] == text.split() and [t.pos for t in tokens] == list(range(3002))


def test_progress_stream_counts_repeats_once(spark):
    folder, schema = new_path(spark, "ends"), "scan_id long, uuid string, status string, ts timestamp"
    rows = [(1, "a", "ok"), (1, "b", "failed"), (1, "a", "ok"), (2, "a", "ok")]
    def write(part):
        df = spark.createDataFrame(part, "scan_id long, uuid string, status string")
        df.withColumn("ts", F.timestamp_seconds(F.lit(1700000000))).coalesce(1).write.mode("append").parquet(folder)
    path, state = new_path(spark, "out"), new_path(spark, "state")
    for part in (rows[:2], rows[2:]):
        write(part)
        stream = spark.readStream.schema(schema).parquet(folder)
        jobs.progress_stream(stream, path, state, available_now=True).awaitTermination()
    got = {tuple(r) for r in jobs.latest_counts(spark, path).collect()}
    batch = prog.scan_counts(prog.finished_files(spark.read.schema(schema).parquet(folder)))
    assert got == {tuple(r) for r in batch.select("scan_id", "finished", "ok", "failed").collect()} == {(1, 2, 1, 1), (2, 1, 1, 0)}


def test_recompute_runs_once_per_company(spark):
    folder, schema = new_path(spark, "requests"), "company_id long, trigger string, request_id long, ts timestamp"
    df = spark.createDataFrame([(1, "names", 1), (1, "scan", 2), (2, "names", 3)], "company_id long, trigger string, request_id long")
    df.withColumn("ts", F.timestamp_seconds("request_id")).coalesce(1).write.parquet(folder)
    seen = []
    stream = spark.readStream.schema(schema).parquet(folder)
    jobs.recompute_stream(
        stream, lambda batch, n: seen.extend((r.company_id, r.trigger, r.revoked) for r in batch.collect()),
        new_path(spark, "state"), available_now=True,
    ).awaitTermination()
    assert sorted(seen) == [(1, "scan", 1), (2, "names", 0)]


def test_conform_nested_contract(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([('{"a": 1}',), ('{"b": "x"}',), ("{",)], "body string")
    out = records.conform_records(df, "body", schema, ["a"], {"b": F.lit("d")}).collect()
    assert [(r.a, r.b, r.errors) for r in out] == [(1, "d", []), (None, "x", ["missing:a"]), (None, None, ["malformed"])]


def test_dictionary_finds_terms_behind_thousands_of_short_words(spark):
    docs = spark.createDataFrame([(1, "a " * 2_040 + "Deep Hit, and more")], "doc_id long, text string")
    terms = spark.createDataFrame([("deep hit", "X")], "term string, label string")
    found = entities.dictionary_mentions(docs, terms).collect()
    assert [(r.start, r.end, r.occurrence) for r in found] == [(4_080, 4_088, "Deep Hit")]


def test_many_spans_in_one_text(spark):
    text = " ".join(f"010203-{k:04d}" for k in range(3_000))
    docs = spark.createDataFrame([(1, "é " + text)], "doc_id long, text string")
    found = entities.find_national_ids(docs).orderBy("start").collect()
    assert [(r.start, r.occurrence) for r in found] == [(2 + 12 * k, f"010203-{k:04d}") for k in range(3_000)]


def test_arrivals_without_identity_stay(spark):
    rows = [(1, None, "m", "n"), (2, None, "m", "n"), (3, 1, None, None), (4, 1, "m", None)]
    docs = spark.createDataFrame(rows, "doc_id long, company_id long, md5 string, name string")
    found = {r.doc_id: (r.canonical_doc_id, r.is_new) for r in ingest.dedupe_documents(docs).collect()}
    assert found == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True)}
    stored = {r.doc_id: r.canonical_doc_id for r in ingest.dedupe_documents(docs.filter("doc_id > 1"), docs.filter("doc_id = 1")).collect()}
    assert stored == {2: 1, 3: 3, 4: 4}


def test_null_size_has_a_reason(spark):
    listing = spark.createDataFrame([("docx", None, None, None)], "ext string, size_mb double, listing_error string, mail_date string")
    assert ingest.with_reject_reason(listing, ["docx"], 1.0).first().reject_reason == "no_size"


def test_character_references(spark):
    from inkspan.functions.html import decode_entities

    row = spark.range(1).select(
        decode_entities(F.lit("&eacute;&#233;&#xE9;&#x1F600; &amp;lt; &none; &#0; &#xD800; A&nbsp;B &")).alias("t")
    ).first()
    assert row.t == "ééé😀 &lt; &none; &#0; &#xD800; A B &"


def test_header_is_not_the_head(spark):
    from inkspan.functions.html import html_text

    assert spark.range(1).select(html_text(F.lit("<head>x</head><header>Kept</header> text")).alias("t")).first().t == "Kept text"


def test_deep_categories_stay_and_cycles_end(spark):
    chain = [("0", "c", None)] + [(str(k), "c", str(k - 1)) for k in range(1, 7)] + [("x", "c", "y"), ("y", "c", "x")]
    cats = spark.createDataFrame(chain, "category_id string, name string, parent_id string")
    assert {r.category_id: r.depth for r in views.category_tree(cats).collect()} == {str(k): k for k in range(7)}


def test_list_fields_in_records(spark):
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("k", T.LongType())])
    df = spark.createDataFrame([('{"ids": [1, 2], "k": 3}',), ('{"ids": "no", "k": 3}',), ('{"k": 3}',)], "props string")
    rows = records.conform_records(df, "props", schema, ["ids"]).collect()
    assert [(r.ids, r.errors) for r in rows] == [([1, 2], []), (None, ["type:ids"]), (None, ["missing:ids"])]


def test_late_and_repeated_ends_over_batches(spark, tmp_path):
    rows = [(1, "a", "failed", 0), (1, "b", "ok", 1), (1, "a", "ok", 60), (1, "c", "failed", 61), (1, "b", "failed", 2)]
    start = dt.datetime(2024, 1, 1)
    schema = "scan_id long, uuid string, status string, ts timestamp"
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for k, (scan, uuid, status, day) in enumerate(reversed(rows)):
        spark.createDataFrame([(scan, uuid, status, start + dt.timedelta(days=day))], schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, "*.parquet", spark.createDataFrame([], schema).schema)
        jobs.progress_stream(stream, path, state, available_now=True).awaitTermination()
    row = jobs.latest_counts(spark, path).first()
    assert (row.finished, row.ok, row.failed) == (3, 2, 1)


def test_ancestors_of_deep_trees_and_cycles(spark):
    rows = [("0", None)] + [(str(k), str(k - 1)) for k in range(1, 6)] + [("x", "y"), ("y", "x")]
    cats = spark.createDataFrame(rows, "category_id string, parent_id string")
    found = {(r.category_id, r.ancestor_id): r.up for r in classify.ancestors(cats).collect()}
    assert {k: v for k, v in found.items() if k[0] == "5"} == {("5", str(k)): 5 - k for k in range(6)}
    assert {k: v for k, v in found.items() if k[0] == "x"} == {("x", "x"): 0, ("x", "y"): 1}


def test_documents_without_features_are_predicted(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    features = spark.createDataFrame([(1, "w", 2.0)], "doc_id long, feature string, value double")
    weights = spark.createDataFrame(
        [("a", "w", 1.0), ("b", "w", -1.0), ("a", classify.INTERCEPT, 0.0), ("b", classify.INTERCEPT, 0.5)],
        "label string, feature string, weight double",
    )
    scores = classify.score_features(classify.with_intercept(features, docs), weights)
    assert {r.doc_id: r.label for r in classify.predict_proba(scores).collect()} == {1: "a", 2: "b"}
