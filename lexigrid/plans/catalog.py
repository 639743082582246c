"""Registered queries and their SQL."""

from __future__ import annotations

from . import corpus_queries, more_queries, vector_queries

QUERIES: dict = {**corpus_queries.QUERIES, **vector_queries.QUERIES, **more_queries.QUERIES}
ORACLE: dict = {**corpus_queries.ORACLE, **vector_queries.ORACLE, **more_queries.ORACLE}
