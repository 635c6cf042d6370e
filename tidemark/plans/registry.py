"""Registered queries and their reference SQL."""

from __future__ import annotations

import importlib

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
_MODULES = ("signals", "joins", "texts", "reports", "narratives", "portfolio", "volatility", "book", "tables", "streams", "extras", "feeds")


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with DuckDB SQL for the same rows where there is some."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"tidemark.plans.{m}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
