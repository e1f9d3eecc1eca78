"""Registry of queries with their SQL twins.

A query is registered with ``@query(key, sql)``.  The SQL may use the views of
``views.SQL``; ``full_sql`` puts the ones it needs in front as CTEs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import SQL as VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def full_sql(sql: str) -> str:
    names = _needed(sql, [])
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    head = "WITH RECURSIVE "
    if body[:5].upper() == "WITH ":
        body = body[5:].lstrip()
        if body[:10].upper() == "RECURSIVE ":
            body = body[10:].lstrip()
        return f"{head}{ctes},\n{body}"
    return f"{head}{ctes}\n{body}"
