"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.sources.tables import ITEMS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name. sql may begin with further CTEs; `items` is there already."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            ORACLES[f.__name__] = f"WITH RECURSIVE {ITEMS_SQL}" + (f", {text[4:].lstrip()}" if text.upper().startswith("WITH") else f" {text}")
        return f

    return add
