"""All queries of the library and their oracle SQL."""

from __future__ import annotations

from tierlink.plans import answer_queries, build_queries, construct_queries, graph_queries, neighbour_queries, rank_queries, source_queries, text_queries, training_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (text_queries, build_queries, rank_queries, graph_queries, construct_queries, answer_queries, source_queries, training_queries, neighbour_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
