"""Names of queries, their functions and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .tables import Tables, sql

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(text: str | None) -> Callable:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = sql(text)
        return f

    return register
