"""Tables written to the folder that driver and executors share, and ranks over them without a global window."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: join_unique() broadcasts at most so many rows of its right side.
MAX_HEAVY = 1000

_roots: dict[str, str] = {}
_scopes: list[list[Workspace]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = tempfile.mkdtemp(prefix="lexspan-")
        atexit.register(shutil.rmtree, _roots[app], ignore_errors=True)
    return f"file://{_roots[app]}"


class Workspace:
    """A folder of written tables below the shared root; it cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/lexspan/{name}-{uuid.uuid4().hex}"
        if _scopes:
            _scopes[-1].append(self)

    def stage(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write `df` once as Parquet and return a reader of it with the same schema."""
        at = f"{self.path}/{name}"
        df.write.options(**options).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str = "") -> None:
        """Delete one staged table (or all) that no later plan reads."""
        at = f"{self.path}/{name}".rstrip("/")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Workspaces made inside are deleted at the end: whatever was read from them must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for ws in _scopes.pop():
            ws.drop()


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "left") -> DataFrame:
    """Join `left` with `right`, which has one row for each key and in `count` how many left rows have it.

    A key with at least 1/MAX_HEAVY of all counted rows is heavy: there can be MAX_HEAVY of them at most, whatever
    the data, so these are broadcast and their left rows stay where they are. All other left rows are shuffled;
    none of their keys holds more than that share. Both sides should be staged tables: each is read twice.
    Keys must not be null on the right; a left row with a null key finds nothing.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    bar = max(math.ceil(total / MAX_HEAVY), 1000)
    heavy = right.where(F.col(count) >= bar).withColumn("__heavy", F.lit(True))
    light = right.where(F.col(count) < bar)
    tagged = left.join(F.broadcast(heavy), keys, "left")
    hot = tagged.where("__heavy").drop("__heavy")
    cold = tagged.where("__heavy is null").select(*left.columns).join(light, keys, how)
    return hot.unionByName(cold)


def ranked(ws: Workspace, df: DataFrame, order: list[Column], rank: str, size: Column | None = None) -> DataFrame:
    """`df` with `rank`: rows before this one in `order` (or the sum of `size` over them), from 0, without a global window.

    The rows are range-sorted and staged with their partition's number; partition totals (a row for each partition)
    give each partition its base.
    """
    size = F.lit(1) if size is None else size
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = ws.stage(parts.select("*", size.cast("long").alias("__size"), F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")), f"ranked-{rank}")
    base = kept.groupBy("__part").agg(F.sum("__size").alias("__total"))
    base = base.select("__part", (F.sum("__total").over(Window.orderBy("__part")) - F.col("__total")).alias("__base"))
    inside = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row for each partition of one exchange: a few thousand at most
    return kept.withColumn("__run", F.sum("__size").over(inside) - F.col("__size")).join(F.broadcast(base), "__part").withColumn(rank, F.col("__run") + F.col("__base")).drop("__part", "__row", "__run", "__base", "__size")
