"""Registry of the engine's queries: name, DataFrame plan, and the same in DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function's name, with the SQL that gives the same rows."""

    def register(plan: Plan) -> Plan:
        name = plan.__name__
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register
