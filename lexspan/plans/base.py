"""Registration of queries with their oracle, and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ORACLES, QUERIES


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with DuckDB SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts as a timestamp of the session's zone (UTC)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"{value}::bigint"
    return str(value) if isinstance(value, float) else "'" + value.replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """A VALUES relation for the oracle."""
    return "(values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") v({columns})"


def relation(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """The same relation for Spark; column types come from the first value that isn't null."""
    kinds = {str: "string", bool: "boolean", int: "long", float: "double"}
    names = [c.strip() for c in columns.split(",")]
    schema = ", ".join(f"{n} {kinds[type(next(r[i] for r in rows if r[i] is not None))]}" for i, n in enumerate(names))
    return spark.createDataFrame(rows, schema)


def pick(choices: list, number):
    """The choice that a number's remainder names: forms of text for the rows of a table."""
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(number, F.lit(len(choices))) + 1).cast("int"))


def pick_sql(choices: list, number: str) -> str:
    return "[" + ", ".join(map(literal, choices)) + f"][(({number}) % {len(choices)} + 1)::int]"
