"""The query registry: name → Spark query and, where SQL can say it, DuckDB text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from importlib import import_module
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from corpusloom.workload.sql import compose
from corpusloom.workload.tables import Tables


class Query(NamedTuple):
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
MODULES = ("ingest", "chunking", "labeling", "reviewing", "reporting", "maintenance")


def query(name: str, sql: str | None = None, needs: Sequence[str] = (),
          extra: Sequence[tuple[str, str]] = ()):
    """Register a query under a name that starts with its inventory id."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(build, compose(list(needs), sql, list(extra)) if sql else None)
        return build

    return register


def load() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"corpusloom.workload.queries.{module}")
    return QUERIES


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: q.build(Tables(spark, sf_dir))
