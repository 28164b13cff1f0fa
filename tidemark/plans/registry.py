"""Named queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.views import VIEWS, Bound

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def expand(sql: str) -> str:
    """Put the view definitions a query uses in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    head = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        recursive = "RECURSIVE " if body[5:].upper().startswith("RECURSIVE ") else ""
        return f"WITH {recursive}{head},\n{body[5 + len(recursive):]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a function of the bound views under a key."""

    def add(fn: Callable[[Bound], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Bound(spark, folder))
        if sql is not None:
            SQL[name] = expand(sql)
        return fn

    return add
