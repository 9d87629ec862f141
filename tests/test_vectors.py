"""Document vectors: the same on any partitions, and nearest for copies."""

import random

import numpy as np

from inkspan.operators import features


def test_vectors_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    runs = [{r.doc_id: r.vector for r in features.document_vectors(docs.repartition(n)).collect()} for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 60


def test_nearest_neighbours_of_planted_copies_are_the_copies(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices([f"w{j}" for j in range(2000)], k=120))) for k in range(80)]
    for k in range(20):
        words = rows[k][1].split()
        for _ in range(12):
            words[rng.randrange(120)] = f"x{rng.randrange(500)}"
        rows.append((100 + k, " ".join(words)))
    rows += [(200, ""), (201, None), (202, "!!")]
    found = {r.doc_id: np.array(r.vector) for r in features.document_vectors(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == 103 and not found[200].any() and not found[201].any() and not found[202].any()
    ids = [k for k, _ in rows[:100]]
    matrix = np.stack([found[k] / np.linalg.norm(found[k]) for k in ids])
    near = matrix @ matrix.T - 2 * np.eye(len(ids))
    assert all(ids[near[k].argmax()] == 100 + k for k in range(20))


def test_user_vectorizer(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "bbb")], "doc_id long, text string")
    made = features.vectorized_features(docs, lambda: lambda texts: [{"b": t.count("b"), "n": len(t)} for t in texts])
    assert {tuple(r) for r in made.collect()} == {(1, "b", 1.0), (1, "n", 3.0), (3, "b", 3.0), (3, "n", 3.0)}
