"""Registered queries: name, Spark plan and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Plan
    sql: str | None


REGISTRY: dict[str, Query] = {}


def add(name: str, run: Plan, sql: str | None = None) -> None:
    if name in REGISTRY:
        raise ValueError(f"query {name!r} is registered twice")
    REGISTRY[name] = Query(name, run, sql)


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(run: Plan) -> Plan:
        add(name, run, sql)
        return run
    return register


def load_all() -> dict[str, Query]:
    from sitegauge.plans import (  # noqa: F401  (importing registers the queries)
        climate_queries, dataset_queries, feature_queries, geo_queries, image_queries, metric_queries,
        ml_queries, scoring_queries, source_queries, stream_queries)
    return REGISTRY
