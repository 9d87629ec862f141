"""Common anchors are seen whatever the ids of their rows."""

from inkspan.llm import repeats


def test_rows_of_one_id_are_counted(spark):
    hot = " ".join(f"h{k}" for k in range(20))
    for doc in (None, 3):
        docs = spark.createDataFrame([(doc, f"{hot} {k}") for k in range(1500)], "doc_id long, text string")
        anchors = repeats.repeated_anchors(repeats._keys(docs, "doc_id", "text"))
        assert anchors.agg({"n": "max"}).first()[0] >= 1500
