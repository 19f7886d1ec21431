"""Tables that change together: data in folders of their own, named by numbered manifests."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A scoped table's manifest has an entry for each scope, so there can be so many at most.
MAX_SCOPES = 200_000


class Conflict(RuntimeError):
    """Another writer has committed since the state that a commit is based on."""


class Snapshots:
    """A folder with data folders and manifest-<number>.json files, each of which names the data of one state.

    Writers put new data into folders with names of their own, which nobody reads yet, and commit by a new manifest: written
    under a temporary name and renamed to a name that must not exist. Until that rename the state before stands, whatever
    stopped the writer; of two writers from the same state the second gets Conflict. A reader takes the manifest
    with the largest number once, so all its tables are of one state; its files stay until vacuum().

    The rename must be atomic, as it is on HDFS and local disks.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        """Numbers of the states that there are."""
        if not self._fs.exists(self._at("")):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at("")))
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-"))

    def state(self, number: int | None = None) -> dict:
        """A state: number, tables (name -> entries with `at`, the data's folder) and facts. The newest one by default; 0 is empty."""
        found = self.numbers() if number is None else [number]
        if not found or found[-1] == 0:
            return {"number": 0, "tables": {}, "facts": {}}
        file = self._fs.open(self._at(f"manifest-{found[-1]:010d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(file)))
        finally:
            file.close()

    def write(self, rows: DataFrame, table: str, partition_by: Iterable[str] = (), **options) -> str:
        """Write rows into a new folder, which the state that is committed next may name; its name."""
        at = f"{table}/{uuid.uuid4().hex}"
        rows.write.options(**options).partitionBy(*partition_by).parquet(f"{self.path}/{at}")
        return at

    def commit(self, base: dict, tables: dict | None = None, facts: dict | None = None) -> dict:
        """The state after `base` with these tables' entries and facts; others stay as they are."""
        state = {"number": base["number"] + 1, "tables": base["tables"] | (tables or {}), "facts": base["facts"] | (facts or {})}
        temporary, final = self._at(f"_manifest-{uuid.uuid4().hex}"), self._at(f"manifest-{state['number']:010d}.json")
        if self._fs.exists(final):
            raise Conflict(f"state {state['number']} of {self.path} is there already")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        keep = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        keep[0] = self._hadoop.Options.Rename.NONE
        try:
            self._hadoop.FileContext.getFileContext(temporary.toUri(), self._conf).rename(temporary, final, keep)
        except Exception as failed:
            if "FileAlreadyExists" in str(failed):
                raise Conflict(f"state {state['number']} of {self.path} is there already") from failed
            raise
        return state

    def read(self, names: Iterable[str], schema) -> DataFrame:
        """The rows of some data folders; of none, an empty table."""
        paths = [f"{self.path}/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1, older_than: float = 86_400) -> list[str]:
        """Delete all manifests but the newest `keep`, and data folders that these don't name and that nobody has touched for
        `older_than` seconds (a writer may be about to name them). Returns the folders that went."""
        numbers = self.numbers()
        named = {"/".join(e["at"].split("/")[:2]) for n in numbers[-keep:] for entries in self.state(n)["tables"].values() for e in entries}
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"manifest-{n:010d}.json"), False)
        gone, bar = [], (time.time() - older_than) * 1000
        for table in self._fs.listStatus(self._at("")) if numbers else []:
            if table.isDirectory():
                for folder in self._fs.listStatus(table.getPath()):
                    name = f"{table.getPath().getName()}/{folder.getPath().getName()}"
                    if name not in named and folder.getModificationTime() <= bar:
                        self._fs.delete(folder.getPath(), True)
                        gone.append(name)
        return sorted(gone)


class ScopedTable:
    """A table on disk whose rows lie in one folder for each value of its scope columns, so that a change writes the folders
    of the scopes it touches and no other, and takes effect as a whole by a commit of Snapshots.

    Nulls in scope columns are values of their own. A scope has a line in the manifest (MAX_SCOPES at most); its folder may
    have any number of files. For a table without natural scopes, `buckets` deals the rows to scopes by a hash of the
    columns named as scope.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, scope: list[str], buckets: int | None = None):
        self.snapshots, self.schema, self.scope, self.buckets = Snapshots(spark, path), schema, scope, buckets
        self.spark = spark

    def _scope(self) -> Column:
        """The scope of a row as text: JSON of its values, or a bucket's number."""
        if self.buckets:
            return F.pmod(F.xxhash64(*self.scope), F.lit(self.buckets)).cast("string")
        return F.to_json(F.array(*[F.col(c).cast("string") for c in self.scope]))

    def _scopes(self, rows: DataFrame) -> list[str]:
        """The scopes of some rows: entries of a manifest, so their number is bounded by MAX_SCOPES."""
        found = [r[0] for r in rows.select(self._scope().alias("s")).distinct().limit(MAX_SCOPES + 1).collect()]
        if len(found) > MAX_SCOPES:
            raise ValueError(f"more than {MAX_SCOPES} scopes: use buckets")
        return found

    def name(self, *values) -> str:
        """The name of the scope with these values."""
        return json.dumps([None if v is None else str(v) for v in values], separators=(",", ":"), ensure_ascii=False)

    def read(self, state: dict | None = None, scopes: list[str] | None = None) -> DataFrame:
        """The rows of a state (the newest by default), of some scopes only if these are given; other folders aren't opened."""
        entries = (state or self.snapshots.state())["tables"].get("rows", [])
        wanted = None if scopes is None else set(scopes)
        return self.snapshots.read((e["at"] for e in entries if wanted is None or e["scope"] in wanted), self.schema)

    def _put(self, base: dict, rows: DataFrame, touched: list[str], facts: dict | None) -> dict:
        place = F.md5(self._scope())
        # rebalancing splits a large scope over tasks and puts small ones together
        at = self.snapshots.write(rows.withColumn("__scope", place).hint("rebalance", "__scope"), "rows", ["__scope"])
        made = self._scopes(self.spark.read.schema(self.schema).parquet(f"{self.snapshots.path}/{at}")) if touched else []
        if outside := set(made) - set(touched):
            raise ValueError(f"rows outside the scopes that are replaced: {sorted(outside)[:3]}")
        entries = [e for e in base["tables"].get("rows", []) if e["scope"] not in set(touched)]
        entries += [{"scope": s, "at": f"{at}/__scope={hashlib.md5(s.encode()).hexdigest()}"} for s in made]
        if len(entries) > MAX_SCOPES:
            raise ValueError(f"more than {MAX_SCOPES} scopes: use buckets")
        return self.snapshots.commit(base, {"rows": entries}, facts)

    def replace(self, rows: DataFrame, scopes: list[str] | None = None, facts: dict | None = None, base: dict | None = None) -> dict:
        """All rows of some scopes anew: those that `rows` have rows of, or the ones that are named (which may end up empty)."""
        rows = rows.select(*self.spark.createDataFrame([], self.schema).columns)
        return self._put(base or self.snapshots.state(), rows, self._scopes(rows) if scopes is None else scopes, facts)

    def delete(self, scopes: list[str]) -> dict:
        """Forget some scopes; nothing is written but the manifest."""
        base = self.snapshots.state()
        return self.snapshots.commit(base, {"rows": [e for e in base["tables"].get("rows", []) if e["scope"] not in set(scopes)]})

    def change(self, new: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], facts: dict | None = None, base: dict | None = None) -> dict:
        """Replace the scopes of `new` by merged(their rows, new). `new` is read several times."""
        base = base or self.snapshots.state()
        touched = self._scopes(new)
        return self._put(base, merged(self.read(base, touched), new), touched, facts)


def once(table: ScopedTable, stream: str, merged: Callable[[DataFrame, DataFrame], DataFrame], tries: int = 5) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: takes each batch of a stream into the table exactly once. The number of the last batch is committed
    with its rows, so a batch that comes again after a failure changes nothing; on Conflict the batch is merged anew."""

    def take(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for left in range(tries - 1, -1, -1):
                base = table.snapshots.state()
                ledger = base["facts"].get("ledger", {})
                if ledger.get(stream, -1) >= number:
                    return
                try:
                    table.change(batch, merged, {"ledger": ledger | {stream: number}}, base)
                    return
                except Conflict:
                    if not left:
                        raise
        finally:
            batch.unpersist()

    return take
