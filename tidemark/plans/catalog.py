"""All queries by name: each a function of (spark, sf_dir)."""

from __future__ import annotations

from tidemark.plans import decision_queries, extract_queries, io_queries, market_queries, metric_queries, premium_queries, risk_queries
from tidemark.sources.adapters import Tables

MODULES = (risk_queries, decision_queries, premium_queries, metric_queries, market_queries, extract_queries, io_queries)


def _bound(query):
    return lambda spark, sf_dir: query(Tables(spark, sf_dir))


QUERIES = {name: _bound(query) for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
