"""Registry of runnable queries; each may carry the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

RUNS: dict[str, Run] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in RUNS:
            raise ValueError(f"query {name} registered twice")
        RUNS[name] = run
        if sql:
            CHECKS[name] = " ".join(sql.split())
        return run

    return register
