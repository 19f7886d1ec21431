"""What the operators share: the staging area, distributed ranks and joins that withstand hot keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import Workspace, join_unique, ranked, scratch, shared_root

__all__ = ["LAST_ID", "UPPER", "WHITE", "WORD", "Workspace", "documents", "join_unique", "one_each", "ranked", "scratch", "shared_root", "word_count"]

#: The six white-space characters of the contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\f\r"
#: A word is a run of anything else (same text in Java, RE2 and Python).
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null doc_id where an order is needed: after every other document.
LAST_ID = 2**63 - 1


def _spark_hash(values: np.ndarray) -> np.ndarray:
    """Spark's hash() of 32-bit integers (Murmur3, x86, 32 bits, seed 42), which its hash partitioning takes modulo the partitions."""
    turn = lambda x, n: x << np.uint32(n) | x >> np.uint32(32 - n)
    h = turn(values.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(h ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def one_each(n: int) -> np.ndarray:
    """n integers that repartition(n, column of them) puts in n different partitions; small numbers themselves would collide."""
    found, start, step = np.full(n, -1), 0, 4 * n + 64
    while (found < 0).any():
        values = np.arange(start, start + step)
        found[_spark_hash(values)[::-1] % n] = values[::-1]
        start += step
    return found


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
