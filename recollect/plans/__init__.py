"""Queries over the driver's tables by name, with the SQL they are checked against.

Doubles are rounded to six places on both sides; every order ends in a unique id.
"""

from __future__ import annotations

from . import compaction, gating, parts, ranking, recall, retrieval, sessions, stores, streams, texts

MODULES = (retrieval, texts, gating, ranking, recall, sessions, compaction, stores, streams, parts)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
