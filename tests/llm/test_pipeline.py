"""The pipeline, stage by stage, against plain versions."""

import random

import numpy as np
import pytest
import tiktoken
from test_corpus_operators import distance, plain_groups, variants, words
from test_text_operators import KEY, plain_secrets

import __spark_entry__ as entry
import corpus_pipeline
from inkspan.llm import bpe, decontaminate, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(21)
    noun = [f"term{k}" for k in range(500)]
    items = [(k, " ".join(rng.choices(noun, k=25))) for k in range(5)]
    texts = [". ".join(" ".join(rng.choices(noun, k=9)) for _ in range(6)) for _ in range(400)]
    for k in range(0, 400, 6):
        texts[k] += " vilestuff horridthing."
    for k in range(1, 400, 40):
        texts[k] += " " + rng.choice(items)[1] + "."
    for k in range(3, 400, 40):
        texts[k] += f" password = {KEY.lower()} and {KEY} é."
    texts += variants(rng, 30, 90) + ["", None, "short", "short", " \n"]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, None, None, None, None), (2, texts[2], None, "again", None)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/documents.parquet")
    marks = [(k, int(k < 400 and k % 6 == 0)) for k in range(len(texts))]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


@pytest.fixture(scope="module")
def steps(spark, corpus):
    docs, out = spark.read.parquet(f"{corpus[0]}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, corpus[0]), name)
        out.append((docs, [r.asDict() for r in docs.collect()]))
    return out


def test_all_operators_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in entry.queries() if name.startswith("op"))
    assert numbers == list(range(1, 14)) and entry.queries()["pipeline"] is corpus_pipeline.run


def test_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontaminate", "secrets", "byte_bpe"]
    assert all(df.columns == COLUMNS for df, _ in steps[:-1])


def test_toxic_documents_go_and_clean_ones_stay(steps, corpus):
    kept = [r["doc_id"] for r in steps[0][1]]
    toxic = {k for k in range(0, 400, 6)}
    assert len(toxic & set(kept)) <= 3 and len(kept) >= len(corpus[1]) - len(toxic) - 3
    assert None in kept


def test_one_document_of_each_group_stays(steps):
    rows = [(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in steps[0][1]]
    groups = plain_groups(sorted(set(rows), key=lambda r: r[0]), 5)
    kept = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in steps[1][1])
    assert kept == sorted({top for _, top in groups.values()})


def test_documents_with_items_go(steps, corpus):
    def leaks(text):
        own = words(text)
        return any(
            min(distance(words(item), own), default=99) <= decontaminate.budget(25, decontaminate.RATE) for _, item in corpus[2]
        )

    wanted = [r["doc_id"] for r in steps[1][1] if not leaks(r["text"])]
    assert sorted(wanted, key=str) == sorted((r["doc_id"] for r in steps[2][1]), key=str)
    assert len(wanted) < len(steps[1][1])


def test_secrets_are_masked(steps):
    before = {r["doc_id"]: r for r in steps[2][1]}
    changed = 0
    for r in steps[3][1]:
        old = before[r["doc_id"]]
        if plain_secrets(old["text"] or ""):
            changed += 1
            assert secrets.scan(r["text"].encode()) == [] and "[secret]" in r["text"] and r["n_chars"] == len(r["text"])
        else:
            assert r == old
    assert changed and len(before) == len(steps[3][1])


def test_encoding_is_that_of_the_texts(steps, corpus, spark):
    reference = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in steps[4][1]}
    assert ids == {r["doc_id"]: reference.encode_ordinary(r["text"] or "") for r in steps[3][1]}
    whole = {r.doc_id: r.ids_sha256 for r in entry.queries()["pipeline"](spark, corpus[0]).collect()}
    assert whole == {r["doc_id"]: r["ids_sha256"] for r in steps[4][1]}


def test_empty_tables_and_further_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").selectExpr("*", "1 AS toxicity", "'x' AS secrets", "2 AS doc", "3 AS kept")
    for _, step in corpus_pipeline.STAGES[:-1]:
        empty = step(spark, docs.limit(0), corpus[0])
        assert empty.columns == docs.columns and empty.count() == 0
        some = step(spark, docs.limit(20), corpus[0])
        assert some.columns == docs.columns and 0 < some.count() <= 20
