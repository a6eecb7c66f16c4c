"""The catalogue of registered queries: name -> Spark callable and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Run
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, *covers: str, sql: str | None = None) -> Callable[[Run], Run]:

    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(name, covers, run, sql.strip() if sql else None)
        return run

    return register


_MODULES = (
    "curation_queries",
    "fitting_queries",
    "graph_queries",
    "growth_queries",
    "judging_queries",
    "source_queries",
    "stream_queries",
    "uncertainty_queries",
    "variant_queries",
)


def load_all() -> dict[str, Query]:
    """Import every module that registers queries and return the catalogue."""
    for module in _MODULES:
        import_module(f"rankwell.plans.{module}")
    return QUERIES
