"""Court decisions that cite a section: the query and its page, and the cache of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days for which an answer counts as fresh.
FRESH_DAYS = 30


def query_text(variants: Column) -> Column:
    """Citation variants as one query of a decision search."""
    return F.array_join(variants, " OR ")


def page_number(offset: Column, limit: Column) -> Column:
    return (F.floor(offset / limit) + 1).cast("long")


def from_cache(asked: DataFrame, log: DataFrame, now: Column, key: str) -> DataFrame:
    """`asked` (key, queries) with `cached`: whether the log (key, queries, checked_at) has a fresh answer to the same query list.

    Nothing asked is never answered from the cache; times after `now` aren't fresh.
    """
    known = log.select(key, F.col("queries").alias("__queries"), "checked_at")
    both = asked.join(known, key, "left")
    fresh = (F.col("checked_at") > now - F.expr(f"interval {FRESH_DAYS} days")) & (F.col("checked_at") <= now)
    same = F.to_json("queries") == F.to_json("__queries")
    return both.withColumn("cached", F.coalesce(fresh & same & (F.size("queries") > 0), F.lit(False))).drop("__queries", "checked_at")


def opinions_citing(sections: DataFrame, opinions: DataFrame) -> DataFrame:
    """(section, cluster_id) for opinions (cluster_id, citations) that cite one of a section's variants (section, variants), each once."""
    wanted = sections.select("section", F.explode("variants").alias("cited"))
    given = opinions.select("cluster_id", F.explode("citations").alias("cited"))
    return wanted.join(given, "cited").select("section", "cluster_id").distinct()
