"""All core queries by name, with the SQL that gives the same result where SQL can."""

from __future__ import annotations

from foliolake.plans import aggregate_queries, box_queries, core_problems, json_queries, key_queries, misc_queries, pipeline_queries, relational_queries, resolution_queries, search_queries

FLAGSHIP = "knn_cosine"
_MODULES = (core_problems, aggregate_queries, box_queries, json_queries, key_queries, misc_queries, pipeline_queries, relational_queries, resolution_queries, search_queries)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
