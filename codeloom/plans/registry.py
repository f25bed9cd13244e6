"""Registered queries: a name, the Spark plan and, where SQL can say it, the same question in SQL."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Registers a plan under ``name``; ``covers`` lists the inventory rows it exercises."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, covers, plan, sql)
        return plan

    return register


def load_all() -> dict[str, Query]:
    from codeloom.plans import (  # noqa: F401
        query_build, query_corpus, query_features, query_findings, query_masking, query_metrics,
        query_quality, query_streams, query_taint, query_tenancy, query_text,
    )

    return QUERIES
