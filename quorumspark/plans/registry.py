"""Queries by name: a function of the derived tables, and its DuckDB text."""

from quorumspark.sources.views import Views, oracle

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *more: str, raw: bool = False, once: tuple = ()):
    """Register a function of Views under `name`, with its oracle over the derived tables (raw: over the base tables only). once: derived tables that the query reads several times and that are written first."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir).once(*once))
        if sql:
            ORACLES[name] = sql if raw else oracle(sql, *more)
        return f

    return put
