"""Where queries and their oracles are collected."""

from queries.views import for_duck

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Register a query ``f(spark, sf_dir) -> DataFrame`` and its DuckDB counterpart."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = for_duck(sql)
        return fn

    return add
