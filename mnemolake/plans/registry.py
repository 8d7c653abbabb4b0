"""Names of queries, their plans and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under a name, with its equivalent in SQL if there is one."""

    def put(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return put
