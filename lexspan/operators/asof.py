"""As-of joins: for each row the latest row of another table, by key and time, that isn't later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import Workspace


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, ties: list[str] | None = None) -> DataFrame:
    """`left` with `found`: the row of `right` (a struct) of the same key with the greatest `since` that is not after `at`; of several,
    the last by the columns `ties`. Null where there is none, and for null keys and times.

    Both tables become one, range-sorted by key and time with right rows first at equal times; the last right row is
    carried down each partition, and across partitions by one row for each of them. No pair of rows is made but the
    result's, and a key of any size lies in as many partitions as its rows need.
    """
    ws = Workspace(left.sparkSession, "asof")
    order = [F.col("__key"), F.col("__at"), F.col("__left"), F.col("__tie"), F.col("__id")]
    here = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    there = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    tie = F.struct(*[F.col(c) for c in ties]) if ties else F.struct(F.lit(0).alias("none"))
    kinds = left.select(here.alias("x")).schema["x"].dataType, right.select(there.alias("x")).schema["x"].dataType, right.select(tie.alias("x")).schema["x"].dataType
    a = left.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__left"), F.lit(None).cast(kinds[2]).alias("__tie"), here.alias("__row"), F.lit(None).cast(kinds[1]).alias("__found"))
    b = right.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("__key"), F.col(since).alias("__at"), F.lit(0).alias("__left"), tie.alias("__tie"), F.lit(None).cast(kinds[0]).alias("__row"), there.alias("__found"))
    both = ws.stage(a.unionByName(b).withColumn("__id", F.monotonically_increasing_id()), "both")
    kept = ws.stage(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id()), "sorted")

    carried = F.when(F.col("__left") == 0, F.struct("__key", "__found"))
    ends = kept.groupBy("__part").agg(F.max_by(carried, F.when(F.col("__left") == 0, F.col("__n"))).alias("__end"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition of one exchange
    handed = ends.select("__part", F.last("__end", ignorenulls=True).over(before).alias("__handed"))
    down = Window.partitionBy("__part").orderBy("__n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = kept.withColumn("__last", F.last(carried, ignorenulls=True).over(down)).where("__left = 1").join(F.broadcast(handed), "__part")
    last = F.coalesce("__last", "__handed")
    same = (last["__key"] == F.col("__key")) & F.col("__at").isNotNull()
    return rows.select(*[F.col("__row").getField(c).alias(c) for c in left.columns], F.when(same, last["__found"]).alias("found"))


def in_force(asked: DataFrame, versions: DataFrame, key: str, at: str, starts: str, ends: str, removed: Column | None = None, ties: list[str] | None = None) -> DataFrame:
    """`asked` with `found`: the version in force at a time. A version holds from its start until the next one of its key starts, but not
    from `ends` on (null: open), and not at all once it is a removal."""
    joined = as_of(asked, versions.withColumn("__removed", F.lit(False) if removed is None else F.coalesce(removed, F.lit(False))), key, at, starts, ties)
    holds = ~F.col("found.__removed") & (F.col(f"found.{ends}").isNull() | (F.col(f"found.{ends}") > F.col(at)))
    return joined.withColumn("found", F.when(holds, F.col("found").dropFields("__removed")))
