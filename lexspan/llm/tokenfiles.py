"""Token files: ids of whole documents in range-coded blocks, written and read through Spark's own file sources.

A file is a run of segments, each followed by one line feed:

    magic "LXTOK1\\n\\0", sizes (documents, blocks, bytes of the document table, bytes of the block table; 32 bits each),
    CRC-32 of both tables, document table (zlib: doc_id, null flag, number of ids), block table (bytes of each block),
    blocks of rangecoder.encode_blocks()

All numbers are little-endian. Documents are in ascending doc_id order in a file, and files by name. Blocks start from
nothing and carry a checksum of their ids, so any block of a file can be read alone. Spark's text writer puts the bytes
down as they are, under its commit protocol, on whatever file system the path names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rangecoder import BLOCK_TOKENS, decode_blocks, encode_blocks
from .tokens import encoder

MAGIC = b"LXTOK1\n\0"
#: A task encodes and writes its ids in segments of about so many (a coder's step costs little more for many blocks than for few).
SEGMENT_TOKENS = 16 << 20
#: Bytes of text that a task takes, where there are more than tasks to run at once.
PART_BYTES = 32 << 20
#: Texts that are tokenised together.
BATCH_BYTES = 8 << 20


def raw_strings(values: list[bytes]) -> pa.Array:
    """Bytes as a string column, whatever they hold."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(values), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(values))])


def segment(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    blocks = encode_blocks([ids[i : i + BLOCK_TOKENS] for i in range(0, len(ids), BLOCK_TOKENS)])
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.array(sizes, "<u4").tobytes()
    docs, table = zlib.compress(keys, 6), np.array([len(b) for b in blocks], "<u4").tobytes()
    return b"".join([MAGIC, struct.pack("<IIIII", len(doc_ids), len(blocks), len(docs), len(table), zlib.crc32(docs + table)), docs, table, *blocks])


def segments(data: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, sizes, ids) of each segment of a file's bytes."""
    at = 0
    while at < len(data):
        if data[at : at + 8] != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        n_docs, n_blocks, n_keys, n_table, crc = struct.unpack_from("<IIIII", data, at + 8)
        at += 28
        tables = data[at : at + n_keys + n_table]
        if zlib.crc32(tables) != crc:
            raise ValueError(f"the tables at byte {at} don't match their checksum")
        keys = zlib.decompress(tables[:n_keys])
        null = np.frombuffer(keys, "u1", n_docs, 8 * n_docs)
        doc_ids = [None if x else int(d) for d, x in zip(np.frombuffer(keys, "<i8", n_docs), null, strict=True)]
        sizes = np.frombuffer(keys, "<u4", n_docs, 9 * n_docs).astype(np.int64)
        at += n_keys + n_table
        ends = at + np.cumsum(np.frombuffer(tables, "<u4", n_blocks, n_keys).astype(np.int64))
        blocks = decode_blocks([data[a:b] for a, b in zip([at, *ends[:-1]], ends, strict=True)]) if n_blocks else []
        yield doc_ids, sizes, np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)
        at = int(ends[-1]) if n_blocks else at
        at += data[at : at + 1] == b"\n"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, partitions: int | None = None) -> None:
    """Tokenise whole texts and write them below `path` in ascending doc_id order.

    ids of `vocabulary` without special tokens, then `end_id`. A null or empty text has `end_id` alone; null doc_ids
    come last; rows that repeat a doc_id stay next to each other, ordered by a hash of their texts; an empty table
    leaves files without segments; other columns are not read.

    One shuffle puts the documents in ranges of doc_id. A task holds one segment of ids at a time, or one document if
    that is longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tail = encoder(vocabulary), struct.pack("<H", end_id)
        ids: list[bytes] = []
        keys: list = []
        held = 0
        flush = lambda: pa.RecordBatch.from_arrays([raw_strings([segment(keys, [len(x) // 2 for x in ids], np.frombuffer(b"".join(ids), "<u2"))])], names=["value"])
        for batch in batches:
            step = max(1, len(batch) * BATCH_BYTES // max(1, batch.column("text").nbytes))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                for key, found in zip(part.column("doc_id").to_pylist(), coder.encode(part.column("text")).to_pylist(), strict=True):
                    keys.append(key)
                    ids.append(found + tail)
                    held += len(ids[-1]) // 2
                    if held >= SEGMENT_TOKENS:
                        yield flush()
                        ids, keys, held = [], [], 0
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    order: list[Column] = [F.col("doc_id").asc_nulls_last()]
    if not partitions:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    rows = rows.repartitionByRange(partitions, *order)
    rows.sortWithinPartitions(*order, F.xxhash64("text")).mapInArrow(run, "value string").write.text(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """What token files hold, decoded and checked: file, segment, place (in it), doc_id, n_tokens, ids_crc32, and ids if `with_ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for number, (doc_ids, sizes, ids) in enumerate(segments(data.as_py())):
                    ends = np.cumsum(sizes)
                    parts = [ids[b - n : b].astype("<u4") for b, n in zip(ends, sizes, strict=True)]
                    columns = [pa.array([name.rsplit("/", 1)[1]] * len(parts), pa.string()), pa.array([number] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                    names = ["file", "segment", "place", "doc_id", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "file string, segment int, place int, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(run, schema)


def with_starts(tokens: DataFrame) -> DataFrame:
    """`tokens` (staged) with start: ids of all documents before, over files and segments in order."""
    sums = tokens.groupBy("file", "segment").agg(F.sum("n_tokens").alias("__sum"))
    before = Window.orderBy("file", "segment")  # a row for each segment of millions of ids
    sums = sums.select("file", "segment", (F.sum("__sum").over(before) - F.col("__sum")).alias("__base"))
    inside = Window.partitionBy("file", "segment").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.join(sums, ["file", "segment"]).withColumn("start", F.col("__base") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).drop("__base")
