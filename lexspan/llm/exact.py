"""Exact de-duplication by a log-structured merge index of text digests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, Workspace, join_unique

RUN_SCHEMA = "digest binary, id long, n long"
#: Digests that a memtable holds before it is flushed as a sorted run.
MEMTABLE_ROWS = 200_000
#: Copies that one task compares with their keeper's text.
COPIES_A_TASK = 2_000
#: Bits of the filter of repeated digests for each of them, and at most: 8 MB go to every task, whatever the data. Beyond
#: some 7 million repeated digests more unique ones pass the filter, which costs time and no result.
FILTER_RATE, FILTER_BITS, PROBES = 10, 1 << 26, 5


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def probes(digest: Column) -> tuple[Column, Column]:
    """Two hashes of 31 bits, from which a filter's places come."""
    return F.xxhash64(digest).bitwiseAND(0x7FFFFFFF), F.xxhash64(F.lit("probe"), digest).bitwiseAND(0x7FFFFFFF)


class DigestIndex:
    """Digest -> (smallest id, number of rows), as sorted Parquet runs below one folder.

    insert() adds a level-0 batch: each task keeps a memtable (one entry for each digest, smallest id, count) and
    flushes it whenever it is full, so copies shrink before anything is shuffled; a file is one memtable, sorted.
    compact() deals the entries of all runs to ranges of digests, merges equal digests there, keeping smallest
    identifiers, and writes a sorted run for each range (level 1), with a filter of the digests of several rows. Runs
    carry Parquet bloom filters and min/max of digests, which point lookups use to skip them.

    manifest-<number>.json names the live runs. A new one is written under a temporary name and renamed to a name that
    didn't exist, and runs have names of their own, so whenever a commit fails, the state before it stands; readers take
    the largest number. What a new state replaced is deleted after it stands.
    """

    def __init__(self, spark: SparkSession, path: str, memtable_rows: int = MEMTABLE_ROWS):
        self.spark, self.path, self.memtable_rows = spark, path, memtable_rows
        jvm = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: jvm.Path(f"{path}/{name}")
        self._fs = jvm.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _manifests(self) -> list[str]:
        here = self._fs.listStatus(self._at("")) if self._fs.exists(self._at("")) else []
        return sorted(n for n in (s.getPath().getName() for s in here) if n.startswith("manifest-"))

    def manifest(self) -> dict:
        found = self._manifests()
        if not found:
            return {"number": 0, "level0": [], "level1": [], "filter": None, "filter_bits": 64}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/{found[-1]}").collect()))

    def _commit(self, state: dict) -> None:
        number = state["number"] + 1
        temporary = f"_manifest-{uuid.uuid4().hex}"
        out = self._fs.create(self._at(temporary), True)
        out.write(bytearray(json.dumps(state | {"number": number}).encode()))
        out.close()
        if not self._fs.rename(self._at(temporary), self._at(f"manifest-{number:08d}.json")):
            raise OSError(f"another writer committed state {number} of {self.path}")
        for old in self._manifests():
            if old < f"manifest-{number:08d}.json":
                self._fs.delete(self._at(old), False)

    def _write(self, runs: DataFrame, name: str, **options) -> None:
        runs.write.options(**options).option("parquet.bloom.filter.enabled#digest", "true").parquet(f"{self.path}/{name}")

    def insert(self, rows: DataFrame) -> None:
        """Add rows (digest binary, id long)."""
        limit = self.memtable_rows

        def flush(table: dict) -> pa.RecordBatch:
            keys = sorted(table)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([table[k][0] for k in keys], pa.int64()), pa.array([table[k][1] for k in keys], pa.int64())], names=["digest", "id", "n"])

        def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table: dict[bytes, tuple[int, int]] = {}
            for batch in batches:
                for digest, i in zip(batch.column("digest").to_pylist(), batch.column("id").to_pylist(), strict=True):
                    old = table.get(digest)
                    table[digest] = (i, 1) if old is None else (min(old[0], i), old[1] + 1)
                    if len(table) >= limit:
                        yield flush(table)
                        table.clear()
            if table:
                yield flush(table)

        state = self.manifest()
        name = f"level0-{uuid.uuid4().hex}"
        # a full memtable has just so many entries, so each is a file of its own
        self._write(rows.select("digest", "id").mapInArrow(memtables, RUN_SCHEMA), name, maxRecordsPerFile=limit)
        self._commit(state | {"level0": [*state["level0"], name]})

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return self.spark.read.schema(RUN_SCHEMA).parquet(*[f"{self.path}/{n}" for n in names])

    def compact(self) -> None:
        """Merge every run into level 1 and make its filter; what they replace is deleted after the new manifest stands."""
        state = self.manifest()
        old = [*state["level0"], *state["level1"]]
        name, mark = f"level1-{uuid.uuid4().hex}", f"filter-{uuid.uuid4().hex}"
        # ranges of digests are clusters of digests too: the merge needs no other shuffle
        merged = self._read(old).repartitionByRange("digest").groupBy("digest").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
        self._write(merged.sortWithinPartitions("digest"), name)
        repeated = self._read([name]).where("n > 1")
        bits = min(FILTER_BITS, max(64, FILTER_RATE * repeated.count()))
        one, two = probes(F.col("digest"))
        places = repeated.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.pmod(one + i * two, F.lit(bits)))).alias("at"))
        words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        words.write.parquet(f"{self.path}/{mark}")
        self._commit(state | {"level0": [], "level1": [name], "filter": mark, "filter_bits": bits})
        for n in [*old, *([state["filter"]] if state["filter"] else [])]:
            self._fs.delete(self._at(n), True)

    def maybe_repeated(self, digest: Column) -> Column:
        """Whether the digest may have several rows, by the filter of the last compaction: never false for one that has."""
        state = self.manifest()
        bits = state["filter_bits"]
        words = np.zeros(-(-bits // 64), np.int64)
        if state["filter"]:
            found = self.spark.read.schema("word long, bits long").parquet(f"{self.path}/{state['filter']}").toPandas()
            words[found["word"].to_numpy()] = found["bits"].to_numpy()

        @F.pandas_udf("boolean")
        def held(one: pd.Series, two: pd.Series) -> pd.Series:
            a, b = one.to_numpy(np.int64), two.to_numpy(np.int64)
            hit = np.ones(len(a), bool)
            for i in range(PROBES):
                at = (a + i * b) % bits
                hit &= (words[at >> 6] >> (at & 63)) & 1 == 1
            return pd.Series(hit)

        return held(*probes(digest))

    def table(self) -> DataFrame:
        """digest, id, n: one row for each digest once compacted."""
        state = self.manifest()
        if not state["level0"]:
            return self._read(state["level1"])
        return self._read([*state["level0"], *state["level1"]]).groupBy("digest").agg(F.min("id").alias("id"), F.sum("n").alias("n"))

    def get(self, digest: bytes) -> tuple[int, int] | None:
        """Point lookup; runs whose filter or range excludes the digest are skipped."""
        state = self.manifest()
        found = self._read([*state["level0"], *state["level1"]]).where(F.col("digest") == F.lit(bytearray(digest))).agg(F.min("id"), F.sum("n")).first()
        return None if found[1] is None else (found[0], found[1])


def exact_groups(docs: DataFrame, digest_bits: int = 256, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text) for every row.

    Texts are equal when identical once each run of white space is one space; a null text counts as empty. The
    smallest doc_id of equal texts stays. Digests (the first `digest_bits` of SHA-256) find the groups in a
    DigestIndex; its filter of repeated digests picks the texts to look at (hits), and every hit's text is compared byte
    by byte with its keeper's; digests under which texts differ are regrouped by the texts themselves.

    Defined cases: null doc_ids come after all others (keep_id is null where no row of the group has an id); rows that
    repeat a doc_id and text count in group_size, and as the same document they are all kept or all dropped; an empty
    table gives no rows; other columns are not read.

    A group of copies of any size shrinks in the memtables, is joined by broadcast if it is heavy (join_unique), and is
    compared in tasks of COPIES_A_TASK rows, to each of which its keeper's text goes once.
    """
    ws = Workspace(docs.sparkSession, "exact")
    norm = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), normalised(F.col("text")).alias("norm")).withColumn("sha", F.sha2("norm", 256))
    norm = norm.withColumn("digest", F.substring(F.unhex("sha"), 1, digest_bits // 8))
    seen = ws.stage(norm.select("id", "digest", "sha"), "digests")
    index = DigestIndex(docs.sparkSession, f"{ws.path}/index", memtable_rows)
    index.insert(seen)
    index.compact()
    groups = index.table().select("digest", F.col("id").alias("keep"), F.col("n").alias("size"))

    # only texts that the filter lets through are shuffled
    maybe = norm.select("id", "digest", "norm").where(index.maybe_repeated(F.col("digest")))
    hits = ws.stage(join_unique(maybe, groups.where("size > 1"), ["digest"], "size", "inner"), "hits")
    tasks = F.ceil(F.col("size") / COPIES_A_TASK).cast("int")
    keepers = hits.where("id = keep").groupBy("digest", "size").agg(F.min("norm").alias("kept_norm"))
    keepers = keepers.select("digest", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("__task"), "kept_norm")
    # any task has its keeper's text, so rows may go anywhere: those of a group without ids are spread as well
    compared = hits.withColumn("__task", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), tasks).cast("int")).join(keepers, ["digest", "__task"])
    differ = ws.stage(compared.where("norm != kept_norm").select("digest").distinct(), "differ")

    result = join_unique(seen, groups, ["digest"], "size").select("id", "digest", "sha", "keep", "size")
    if differ.first() is not None:
        again = hits.join(differ, "digest", "left_semi").select("id", "digest", "norm", F.sha2("norm", 256).alias("sha"))
        by_text = again.groupBy("norm").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("size"))
        again = again.join(by_text, "norm").select("id", "digest", "sha", "keep", "size")
        result = result.join(differ, "digest", "left_anti").unionByName(again)
    given = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return result.select(given("id").alias("doc_id"), given("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("id") == F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))
