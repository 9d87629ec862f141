"""Columns named like the operators' helper columns come through unchanged."""

import corpus_pipeline
from inkspan.llm import repeats, secrets, toxicity

HELPERS = ["_doc", "_tag", "_found", "_clean", "_hit", "_rows", "_other", "_DOC_"]


def test_helper_columns_do_not_clash(spark, make):
    texts = ["password = abcdefgh1234 here", "vile thing. fine thing.", None, " ".join(f"w{k}" for k in range(30))] * 3
    rows = [(k, t, *(f"own {h} {k}" for h in HELPERS)) for k, t in enumerate(texts)]
    docs = make(rows, "doc_id long, text string, " + ", ".join(f"`{h}` string" for h in HELPERS))
    marks = make([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
    runs = {
        "redact": secrets.redact(docs),
        "repeats": repeats.remove_repeats(docs),
        "sentences": toxicity.sentences(docs, toxicity.fit(docs, marks), floor=0.0),
        "near": corpus_pipeline.drop_near_duplicates(spark, docs, ""),
        "secrets": corpus_pipeline.mask_secrets(spark, docs, ""),
    }
    for name, out in runs.items():
        got = out.select("doc_id", *[f"`{h}`" for h in HELPERS]).collect()
        assert got, name
        assert all(r[h] == f"own {h} {r.doc_id}" for r in got for h in HELPERS), name
