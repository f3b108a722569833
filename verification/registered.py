"""All registered queries."""

from verification import comparison_queries, diagnostic_queries, quality_queries, series_queries, store_queries, window_queries

MODULES = (quality_queries, series_queries, window_queries, comparison_queries, diagnostic_queries, store_queries)
QUERIES: dict = {}
SQL: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
