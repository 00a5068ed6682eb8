"""Registry of queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.catalog.fixtures import VIEWS, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(fixtures) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Prefix the derived views a statement uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in re.findall(r"\bfx_[a-z_]+\b", text):
            if view in VIEWS and view not in needed:
                visit(VIEWS[view])
                if view not in needed:
                    needed.append(view)

    visit(sql)
    body = sql.strip()
    own = ""
    if body.lower().startswith("with "):
        own = body[5:]
    parts = [f"{v} AS ({VIEWS[v].strip()})" for v in needed]
    if own:
        return "WITH " + ",\n".join([*parts, own])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
