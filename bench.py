"""Time registered queries: ``python bench.py`` for the headline set, ``python bench.py all`` for all.

Reads ``$BENCH_SF_DIR`` (default sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line. Each query
is built and written to the no-op sink, staged tables and streams included; model fitting counts too.
The first query runs once before, so that no time holds the start of the JVM's code.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "find_national_ids",
    "find_phone_numbers",
    "dictionary_ner",
    "dedupe_documents",
    "admit_documents",
    "detect_language",
    "extract_text",
    "exact_name_match",
    "partial_name_match",
    "keyword_match",
    "risk_report",
    "search_ranked",
    "tfidf_text",
    "chi2_select",
    "hierarchical_classify",
    "stratified_kfold",
    "document_index",
    "similar_documents",
    "scan_progress",
    "stream_new_files",
]


def main() -> None:
    from inkspan.plans import registry
    from inkspan.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    picked = sys.argv[1:]
    names = list(registry.QUERIES) if picked == ["all"] else picked or HEADLINE
    spark = local_session(cores, "bench")
    spark.read.parquet(f"{folder}/documents.parquet").write.format("noop").mode("overwrite").save()
    if names:  # warm-up, not timed
        registry.QUERIES[names[0]](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": int(cores),
            }
        )
    )


if __name__ == "__main__":
    main()
