"""The named queries of this subpackage and their SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from termforge.llm import boilerplate_queries, document_queries, encoding_queries, neardup_queries, personal_queries, quality_queries, term_queries

_MODULES = (term_queries, document_queries, neardup_queries, encoding_queries, boilerplate_queries, personal_queries, quality_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
