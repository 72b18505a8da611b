"""Registered queries: each with the DuckDB SQL that gives the same rows."""

from docengine.queries import articles, chunks, contexts, grammar, packages, questions, records, retrieval, stores, structure, subjects, texts

_MODULES = (texts, chunks, retrieval, questions, structure, contexts, records, packages, stores, articles, grammar, subjects)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
