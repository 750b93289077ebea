"""All registered queries of the library and their oracles."""

from __future__ import annotations

from . import event_queries, file_queries, graph_queries, metric_queries, month_queries, text_queries, vector_queries

MODULES = (graph_queries, metric_queries, event_queries, month_queries, vector_queries, text_queries, file_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
