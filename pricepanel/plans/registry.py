"""Catalogue of runnable queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register ``run`` under ``name``; ``sql`` is the same result in ANSI SQL."""

    def add(run: Run) -> Run:
        if name in CATALOGUE:
            raise ValueError(f"query {name} registered twice")
        CATALOGUE[name] = Query(run, sql)
        return run

    return add
