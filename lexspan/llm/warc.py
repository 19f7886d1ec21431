"""WARC archives: range-sorted records in files rolled by compressed size, committed by manifest, and read back.

Each record is a gzip member of its own, so the files are plain .warc.gz files. The writing tasks put them in place: a file
is written under a temporary name and moved to its own name when it is whole. Names and contents depend on the pages
alone, so a task that runs again (or twice) puts the same bytes in the same place. The tasks report their files as rows of
a Parquet table, the list; manifest.json, moved into place last, names the list that counts.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, Workspace, join_unique, one_each, ranked

#: A file ends with the record that brings it to this many compressed bytes; a shard holds payloads of about so many.
ROLL_BYTES, SHARD_BYTES = 8 << 20, 32 << 20
#: Compressed bytes that a reading task takes, where there are more than tasks to run at once.
READ_BYTES = 64 << 20
#: Shards get larger beyond so many, as the first record of each goes to every task.
MAX_SHARDS = 10_000
#: Payloads from this size on are stored once.
MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace for URLs


def _b32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; headers, lengths and the block digest are made anew from the payload. A revisit has no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{_b32(digest)}", f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).hexdigest())}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """The data as one gzip member without name or time."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def store_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a Hadoop-style path as pyarrow opens it (local, HDFS, S3, GCS, ABFS), and the path in it."""
    if re.match("file:|/", path):
        return pa.fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


class _Archive:
    """One file in the making: temporary until close() moves it to its name."""

    def __init__(self, path: str, name: str):
        self.store, root = store_of(path)
        self.name, self.bytes, self.records = name, 0, 0
        self.temporary, self.final = f"{root}/_temporary/{uuid.uuid4().hex}", f"{root}/{name}"
        self.out = self.store.open_output_stream(self.temporary, compression=None)

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes, self.records = self.bytes + len(data), self.records + 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.store.move(self.temporary, self.final)
        return self.name, self.bytes, self.records


LIST = "name string, bytes long, records long"


def write_warc(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> dict:
    """Write a record for each page below `path` in ascending page_id order and return the manifest.

    Of pages with equal payloads of MIN_REVISIT bytes or more the one with the largest page_id is a response, the others
    are revisits of it; smaller payloads are all responses. Pages are ranked by page_id with running payload bytes; every
    shard_bytes of them make a shard, written by one task that starts a new file once the open one has roll_bytes, so
    files and their content depend on the pages alone. An archive counts once its manifest.json (format, sizes, list,
    number of files and bytes) is in place; the list has a row (name, bytes, records) for each file. The driver handles
    no single file.

    The first records of all shards (MAX_SHARDS at most) tell each page its shard; there are as many tasks as shards.

    Defined cases: a null html is an empty payload; null page_ids come last and are always responses; rows that repeat a
    page_id and payload are the same page: all responses, or all revisits; url is optional; an empty table gives a
    manifest without files; other columns are not read. `path` may hold an earlier run of the same pages.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(LAST_ID)).alias("id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("length", F.octet_length("payload").cast("long"))
    meta = rows.select("id", "length", "sha1", F.when((F.col("length") >= MIN_REVISIT) & (F.col("id") != LAST_ID), F.concat_ws("-", F.sha2("payload", 256), "length")).alias("same"))
    meta = ranked(ws, meta, [F.col("id"), F.col("sha1")], "before", size=F.col("length") + 512)
    # no more than MAX_SHARDS first records go to every task
    whole = meta.agg(F.coalesce(F.max("before"), F.lit(0))).first()[0]
    step = max(shard_bytes, -(-whole // MAX_SHARDS))
    meta = ws.stage(meta.withColumn("shard", F.floor(F.col("before") / step)), "meta")
    firsts = sorted(tuple(r[0]) for r in meta.groupBy("shard").agg(F.min(F.struct("id", "sha1"))).select(F.col("min(struct(id, sha1))")).collect())

    @F.pandas_udf("int")
    def shard_of(i: pd.Series, sha1: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(firsts, k) for k in zip(i, sha1, strict=True)], dtype="int32")

    keys = one_each(max(1, len(firsts)))

    @F.pandas_udf("int")
    def place_of(shard: pd.Series) -> pd.Series:
        return pd.Series(keys[shard.to_numpy() - 1], dtype="int32")

    copies = meta.where("same is not null").groupBy("same").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    copies = ws.stage(copies.where("n > 1"), "copies")
    again = join_unique(meta.where("same is not null"), copies, ["same"], "n", "inner").where("id != keep").select("id", "sha1", "keep").distinct()
    # what a revisit refers to comes right before its record, so the pages themselves are shuffled once
    empty = {c: F.lit(None).cast(t) for c, t in (("url", "string"), ("payload", "binary"), ("length", "long"))}
    both = rows.withColumn("keep", F.lit(None).cast("long")).unionByName(again.withColumns(empty))
    dealt = both.withColumn("shard", shard_of("id", "sha1")).withColumn("place", place_of("shard")).repartition(len(keys), "place").sortWithinPartitions("shard", "id", "sha1", F.col("keep").asc_nulls_last(), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = None, 0
        out: _Archive | None = None
        done: list[tuple] = []
        known: tuple = (None, None, None)
        for batch in batches:
            for i, url, payload, sha1, length, s, refers_to in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "sha1", "length", "shard", "keep")), strict=True):
                if refers_to is not None:
                    known = (i, sha1, refers_to)
                    continue
                keep = known[2] if known[:2] == (i, sha1) else None
                if out and (s != shard or out.bytes >= roll_bytes):
                    done.append(out.close())
                    out, number = None, number + 1
                if s != shard:
                    shard, number = s, 0
                out = out or _Archive(path, f"{shard:08d}-{number:05d}.warc.gz")
                out.add(member(record(None if i == LAST_ID else i, url, b"" if keep is not None else payload or b"", sha1, length, keep)))
        if out:
            done.append(out.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("name", "bytes", "records"), d, strict=True)) for d in done], pa.schema({"name": pa.string(), "bytes": pa.int64(), "records": pa.int64()}))

    store, root = store_of(path)
    store.create_dir(f"{root}/_temporary")
    listed = f"list-{uuid.uuid4().hex}"
    dealt.select("id", "url", "payload", "sha1", "length", "shard", "keep").mapInArrow(run, LIST).write.parquet(f"{path}/{listed}")
    files, size = spark.read.schema(LIST).parquet(f"{path}/{listed}").agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    manifest = {"format": "WARC/1.1", "roll_bytes": roll_bytes, "shard_bytes": shard_bytes, "list": listed, "files": files, "bytes": size}
    with store.open_output_stream(f"{root}/_temporary/manifest") as out:
        out.write(json.dumps(manifest).encode())
    store.move(f"{root}/_temporary/manifest", f"{root}/manifest.json")
    store.delete_dir(f"{root}/_temporary")
    ws.drop()
    return manifest


def members(stream) -> Iterator[bytes]:
    """Content of each gzip member of a file or stream, read in windows."""
    window = b""
    while window := window or stream.read(1 << 18):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            window = window or stream.read(1 << 18)
            if not window:
                raise ValueError("a gzip member is cut off")
            parts.append(inflate.decompress(window))
            window = inflate.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Headers and payload of a record; lengths and digests that don't agree raise ValueError."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(headers["content-length"])
    block = rest[:size]
    if version != "WARC/1.1" or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    if headers["warc-block-digest"] != f"sha1:{_b32(hashlib.sha1(block).hexdigest())}":
        raise ValueError("a block doesn't match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    if headers["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload doesn't match its digest")
    number = lambda k: int(headers[k]) if k in headers else None
    return {"page_id": number("warc-page-id"), "url": headers.get("warc-target-uri"), "record_type": headers["warc-type"], "payload": payload, "payload_bytes": length, "payload_digest": digest, "refers_to": number("warc-refers-to-page-id")}


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and records of the files that the archive's manifest counts."""
    store, root = store_of(path)
    with store.open_input_stream(f"{root}/manifest.json") as manifest:
        found = json.loads(manifest.read())
    return spark.read.schema(LIST).parquet(f"{path}/{found['list']}")


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of the files that the manifest counts: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and
    payload). Tasks open the files that their rows of the list name, some READ_BYTES each; a file of another size raises."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if with_payload else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        for batch in batches:
            for name, size in zip(batch.column("name").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if store.get_file_info(f"{root}/{name}").size != size:
                    raise ValueError(f"{name} hasn't the size that the list gives")
                found = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        found.append(parse(data))
                        if not with_payload:
                            del found[-1]["payload"]
                        if len(found) >= 1000:
                            yield pa.RecordBatch.from_pylist(found, pa.schema(types))
                            found = []
                yield pa.RecordBatch.from_pylist(found, pa.schema(types))

    files = listed_files(spark, path)
    size, number = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, min(number, max(spark.sparkContext.defaultParallelism, -(-size // READ_BYTES))))
    return files.select("name", "bytes").repartition(tasks).mapInArrow(run, schema)
