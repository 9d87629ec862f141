"""All registered queries and oracles."""

from __future__ import annotations

from inkspan.plans import classify, entities, features, ingest, names, progress, risk, views

_MODULES = [ingest, entities, names, risk, features, classify, views, progress]

FLAGSHIP = "find_national_ids"

QUERIES = {}
ORACLE = {}
for _module in _MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
