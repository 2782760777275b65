"""Queries over the given tables and their SQL, by operator family."""

from __future__ import annotations

from normata.plans import corpus, laws, logs, retrieval, said, streams, texts

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _family in (logs, texts, said, retrieval, corpus, laws, streams):
    QUERIES |= _family.QUERIES
    ORACLE_SQL |= _family.ORACLE_SQL
FLAGSHIP = "hybrid_search_rrf"
