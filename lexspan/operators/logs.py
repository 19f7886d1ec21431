"""Request-log statistics and rate limits, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def summary(rows: DataFrame, is_error: Column, duration: Column) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(is_error).alias("errors"), F.round(F.avg(duration), 0).cast("long").alias("avg_duration"))


def top(rows: DataFrame, key: Column, name: str, n: int = 10) -> DataFrame:
    """The n most frequent keys, ties by key."""
    return rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(n)


def route(path: Column) -> Column:
    """Path with its first id segment as :id."""
    return F.regexp_replace(path, r"/\d+", "/:id")


def last(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows by `order`, in that order."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def recent_count(rows: DataFrame, who: str, micros: Column, minutes: int) -> DataFrame:
    """How many earlier rows of the same key lie in the trailing minutes before each row (itself and equal times left out)."""
    span = minutes * 60 * 1_000_000
    window = Window.partitionBy(who).orderBy("__t").rangeBetween(-span, -1)
    return rows.withColumn("__t", micros).withColumn("recent", F.count(F.lit(1)).over(window)).drop("__t")


def percentage(part: Column, whole: Column) -> Column:
    """Rounded per cent; 0 where the whole is 0."""
    return F.coalesce(F.round(F.try_divide(part * 100, whole), 0), F.lit(0)).cast("long")


def histogram(rows: DataFrame, key: str) -> DataFrame:
    """Rows of each status."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def fold_users(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts and last event by user, from rows of the same form (user_id, n, last_at, last_type, last_id) of before and of a batch."""
    latest = F.max_by("last_type", F.struct("last_at", "last_id"))
    return old.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last_at").alias("last_at"), latest.alias("last_type"), F.max_by("last_id", F.struct("last_at", "last_id")).alias("last_id"))
