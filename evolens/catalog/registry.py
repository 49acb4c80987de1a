"""The registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``<name>`` or ``<name>_query`` as name, with its SQL equivalent if there is one."""
    def register(function: Query) -> Query:
        name = function.__name__.removesuffix("_query")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
