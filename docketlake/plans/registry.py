"""The registered queries over the stand-in tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketlake.plans.standins import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of Tables under its name, with its oracle."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = oracle(sql)
        return fn

    return add


def load() -> None:
    """Import the modules that register queries."""
    from docketlake.plans import detail_queries, merge_queries, model_queries, scalar_queries, state_queries  # noqa: F401, I001
    from docketlake.plans import audit_queries, job_queries, load_queries  # noqa: F401


load()
