"""How a module of queries collects them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum.sources.tables import with_tables


def joined(values: Column) -> Column:
    """An array as one string, which any engine compares alike."""
    return F.array_join(values.cast("array<string>"), ",")


def registry():
    """(queries, oracles, query): `query(tables, oracle)` registers a function under its name; oracle is SQL over base tables
    and the named logical ones."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(tables: str = "", oracle: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if oracle:
                oracles[f.__name__] = with_tables(tables, oracle) if tables else oracle
            return f

        return register

    return queries, oracles, query
