"""Registered queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlens.plans.fixture import posts_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_posts: bool = True):
    """Register a query; its SQL twin may refer to the ``posts`` view."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_view(sql) if with_posts else sql
        return fn

    return register


def with_view(sql: str) -> str:
    body = sql.strip()
    head = f"WITH RECURSIVE posts AS ({posts_sql()})"
    if body.upper().startswith("WITH "):
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"
