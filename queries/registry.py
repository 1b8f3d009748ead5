"""Collects the queries and completes their SQL with the named steps it uses."""

from __future__ import annotations

import re

QUERIES: dict = {}
SQL: dict[str, str] = {}
STEPS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r(expr: str, digits: int = 6) -> str:
    """Half-up decimal rounding of a double, as Spark's ``round`` does it."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def complete(sql: str) -> str:
    """Put the steps a query mentions, and theirs, in front of it."""
    order: list[str] = []

    def visit(text, path=()):
        for name in STEPS:
            if name not in order and name not in path and re.search(rf"\b{name}\b", text):
                visit(STEPS[name], (*path, name))
                order.append(name)

    visit(sql)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED (\n{STEPS[n].strip()}\n)" for n in order)
    return f"WITH {head}\n{sql.strip()}"
