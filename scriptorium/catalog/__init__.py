"""Registered queries with their SQL counterparts."""

from __future__ import annotations


def _load():
    from scriptorium.catalog import (  # noqa: F401
        aggregate_queries,
        function_queries,
        join_queries,
        label_queries,
        ordered_queries,
        plan_queries,
        source_queries,
    )
    from scriptorium.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES


def queries():
    return dict(_load()[0])


def oracles():
    return dict(_load()[1])
