"""Samples to learn from: one row for each id, and a text that does not fit is passed over."""

from inkspan.llm import personal, toxicity


def _docs(spark):
    rows = [(k, f"plain words here {k % 7}. " + ("vile thing. " if k % 4 == 0 else "fine thing. ")) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    return rows, labels


def test_a_text_above_the_bound_does_not_end_the_sample(spark):
    rows, labels = _docs(spark)
    first = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(doc_id) o", "crc32(string(doc_id)) % 5 c")
    early = {r.doc_id for r in first.filter("c <> 0").orderBy("o").limit(1).collect()}
    long = [(k, "long " * 20_000 if k in early else t) for k, t in rows]
    docs = spark.createDataFrame(long, "doc_id long, text string")
    model = toxicity.fit(docs, labels, max_bytes=50_000)
    scored = toxicity.score(spark.createDataFrame([(1, "A vile thing."), (2, "A fine thing.")], "doc_id long, text string"), model)
    assert [r.toxicity > 0.5 for r in scored.orderBy("doc_id").collect()] == [True, False]


def test_a_repeated_id_brings_one_row(spark):
    rows, labels = _docs(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = docs.union(spark.createDataFrame([rows[4]] * 3000, "doc_id long, text string"))
    assert toxicity.fit(hot, labels) == toxicity.fit(docs, labels)


def test_a_hot_id_does_not_fill_the_sample_of_personal(spark):
    rows = [(k, f"mail to jane{k}@host.org or meet at host.org, list 2.3.4.{900 + k % 90}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = docs.selectExpr("doc_id", "xxhash64(doc_id) o").orderBy("o").first().doc_id
    hot = docs.union(spark.createDataFrame([(first, None)] * 3000, "doc_id long, text string"))
    assert personal.fit(hot, max_documents=300) == personal.fit(docs, max_documents=300)
