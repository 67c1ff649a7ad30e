"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import fixtures
from factloom.plans.fixtures import Facts

_QUERIES: dict[str, Callable[[Facts], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query; ``check`` is the same question as DuckDB SQL."""

    def add(build: Callable[[Facts], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = build
        if check:
            _CHECKS[name] = check
        return build

    return add


def load_all() -> None:
    from factloom.plans import catalog  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()

    def bind(build):
        return lambda spark, sf_dir: build(Facts(spark, sf_dir))

    return {name: bind(build) for name, build in _QUERIES.items()}


def check_sql() -> dict[str, str]:
    load_all()
    return {name: with_fixtures(text) for name, text in _CHECKS.items()}


def with_fixtures(text: str) -> str:
    """Put the fixtures a check uses in front of it as CTEs."""
    text = text.strip()
    once = {"fx_column_flow": "MATERIALIZED "}  # a window over all lines, which other fixtures read several times
    ctes = ",\n".join(f"{name} AS {once.get(name, '')}({fixtures.expand(fixtures.SQL[name])})" for name in fixtures.dependencies(text))
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", text, re.I)
    recursive = "RECURSIVE " if head and head.group(1) else ""
    body = text[head.end():] if head else text
    if not ctes:
        return text
    return f"WITH {recursive}{ctes}{',' if head else ''}\n{body}"
