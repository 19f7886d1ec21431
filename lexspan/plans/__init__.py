"""Registered queries: each module has QUERIES (Spark) and ORACLES (DuckDB SQL)."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

from . import aggregates, documents, filters, joins, lookups, scalars, searches, services, trees, writes  # noqa: E402, F401
