"""All named queries of the library and their SQL."""

from __future__ import annotations

from . import corpus, documents, kept, parts, questions, retrieval

MODULES = (retrieval, documents, questions, corpus, parts, kept)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
