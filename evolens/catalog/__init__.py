"""Every operator as a query over the test tables, with the SQL it is checked against."""

from __future__ import annotations

from evolens.catalog import registry


def _load() -> None:
    from evolens.catalog import (  # noqa: F401
        history_queries,
        model_queries,
        selection_queries,
        source_queries,
        text_queries,
    )


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
