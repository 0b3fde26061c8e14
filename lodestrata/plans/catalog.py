"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import answer_queries, facts_queries, library_queries, retrieval_queries, structure_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _part in (retrieval_queries, structure_queries, facts_queries, library_queries, answer_queries):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
