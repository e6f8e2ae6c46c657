"""Name → query and name → SQL twin, filled by the modules next to this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is the same result in DuckDB SQL on the raw tables."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return function

    return register


_shared: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """Build a shared input (a written table, a fitted model) once per application and directory."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        _shared[key] = build()
    return _shared[key]


def forget() -> None:
    """Drop all shared inputs, so that a benchmark measures the fits again."""
    _shared.clear()
