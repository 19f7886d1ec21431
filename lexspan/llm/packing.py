"""Mixture-controlled packing of token documents into sequences of a fixed size."""

from __future__ import annotations

import math
import struct
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import giving_back
from .common import Workspace, join_unique
from .tokenfiles import BATCH_BYTES
from .tokens import encoder

#: Ids that one task deals into windows (it sees where documents lie, not the ids).
PART_TOKENS = 1 << 22
#: A turn in the round takes at least so many ids of a source, if it still has them.
TURN = 128
#: Documents of a source whose offsets one task adds up.
BUCKET_ROWS = 1_000


def deal(queues: dict[str, deque], shares: dict[str, float], carried: dict[str, float], window: int, turn: int) -> Iterator[tuple[int, int, int, int]]:
    """Deficit round-robin over source queues of [row, start, length].

    Each window grants every source its share of the window's room on top of the deficit it brings along; in turn,
    sources send from the head of their queues what their deficit covers, once that is a turn's worth (or all they
    have left). Room that is left goes to the largest deficits, on credit. Deficits pass to the next window. When the
    queues run dry the rest is dealt into windows whose sizes are powers of two, so nothing is padded. Yields
    (row, start, length, window number) in the order of the window's content.
    """
    left = {s: sum(x[2] for x in q) for s, q in queues.items()}
    total = sum(left.values())
    deficit = {s: carried.get(s, 0.0) for s in queues}
    rounds = deque(sorted(queues))
    number = 0

    def send(source: str, room: int) -> Iterator[tuple[int, int, int, int]]:
        left[source] -= room
        deficit[source] -= room
        queue = queues[source]
        while room:
            row, start, length = queue[0]
            n = min(length, room)
            yield row, start, n, number
            room -= n
            if n == length:
                queue.popleft()
            else:
                queue[0] = (row, start + n, length - n)

    while total:
        size = window if total >= window else 1 << (total.bit_length() - 1)
        room = size
        for source in rounds:
            deficit[source] += shares[source] * size
        for source in list(rounds):
            n = min(int(deficit[source]), left[source], room)
            if n > 0 and n >= min(turn, left[source], room):
                yield from send(source, n)
                room -= n
        rounds.rotate(-1)
        while room:
            source = max((s for s in rounds if left[s]), key=lambda s: (deficit[s], s))
            n = min(room, left[source], max(turn, int(deficit[source])))
            yield from send(source, n)
            room -= n
        total -= size
        number += 1


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = 1024, turn: int = TURN, part_tokens: int = PART_TOKENS, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most `window` ids, every sequence near target token proportions: `targets`
    (a weight for each source, 0 where none is given), or the corpus's own.

    A document is its ids of `vocabulary` and then `end_id` (a null or empty text: `end_id` alone). Returns doc_id,
    source, start (the document's ids before the piece), length, ids_crc32, doc_tokens, sequence_id, offset (place in
    the sequence, from 0 without gaps).

    The ids of each source form one stream, ordered by a hash of doc_id. Part p of P takes of each source the ids from
    floor(T p / P) to floor(T (p + 1) / P), T being the source's total, so every part has the corpus's proportions. These exact
    cuts take the place of deficits handed from part to part: a part starts with what rounding kept from each source in the
    parts before it (under one id), so parts need not wait for each other; within a part deal() carries deficits from window
    to window. With other targets than the corpus's, a part's sources run dry at different times and its last windows hold
    what is left. What is left of a part under a window goes into windows of 2**k ids, so no sequence needs padding.

    Defined cases: an empty table gives no rows; a null source is a source of its own; null doc_ids stay null; repeated
    rows are documents of their own; other columns are not read.

    Ids are tokenised once and staged with a row number; offsets, parts and windows are worked out on (row, source,
    size) alone; the ids are shuffled once, to meet their document's pieces. A task forgets the chunks it has seen when it
    ends, so that workers don't hold them beside later stages.
    """
    ws = Workspace(docs.sparkSession, "pack")
    tail = struct.pack("<H", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        try:
            for batch in batches:
                step = max(1, len(batch) * BATCH_BYTES // max(1, batch.column("text").nbytes))
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    ids = pc.binary_join_element_wise(coder.encode(part.column("text")), tail, b"")
                    size = pc.divide(pc.binary_length(ids), 2).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), size, ids], names=["doc_id", "source", "n", "ids"])
        finally:
            coder.forget()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    tokens = read.mapInArrow(giving_back(run), "doc_id long, source string, n long, ids binary")
    tokens = ws.stage(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    rows = tokens.select("row", "doc_id", "n", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("key"))

    sources = ws.stage(rows.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("docs")), "sources")
    whole, kinds = sources.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, math.ceil(whole / part_tokens))
    spread = F.coalesce("doc_id", "row")  # rows without an id are spread as well
    placed = join_unique(rows, sources, ["key"], "docs", "inner").withColumn("bucket", F.pmod(F.xxhash64(spread), F.ceil(F.col("docs") / BUCKET_ROWS)))
    sums = placed.groupBy("key", "bucket").agg(F.sum("n").alias("sum"))
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select("key", "bucket", (F.sum("sum").over(upto) - F.col("sum")).alias("base"))
    inside = Window.partitionBy("key", "bucket").orderBy(F.xxhash64(spread), "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("run", F.sum("n").over(inside) - F.col("n")).join(sums, ["key", "bucket"]).withColumn("at", F.col("base") + F.col("run"))
    # part p has the ids from floor(T p / P): an id at place x is in part ceil((x + 1) P / T) - 1
    exact = lambda x: f"cast({x} as decimal(18, 0))"  # noqa: E731  products exceed 64 bits on large corpora
    part = lambda x: F.expr(f"({exact(x + ' + 1')} * {exact(parts)} + total - 1) div total - 1")
    cut = placed.withColumn("part", F.explode(F.sequence(part("at"), part("(at + n - 1)"))))
    first, last = F.expr(f"({exact('total')} * {exact('part')}) div {parts}"), F.expr(f"({exact('total')} * {exact('part + 1')}) div {parts}")
    cut = cut.withColumn("from", F.greatest(F.col("at"), first)).withColumn("to", F.least(F.col("at") + F.col("n"), last))
    cut = cut.select("part", "key", "row", (F.col("from") - F.col("at")).alias("start"), (F.col("to") - F.col("from")).alias("length"), "from", "total", "docs")
    room = (part_tokens + kinds) // window + 16  # sequence numbers of a part
    wanted = {"t" if s is None else f"s{s}": float(w) for s, w in (targets or {}).items()}

    def windows(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        p = int(key[0])
        group = group.sort_values(["key", "from"])
        queues: dict[str, deque] = defaultdict(deque)
        for source, row, start, length in zip(group["key"], group["row"], group["start"], group["length"], strict=True):
            queues[source].append((row, start, length))
        totals = dict(zip(group["key"], group["total"].tolist(), strict=True))
        carried = {s: totals[s] * p % parts / parts for s in queues}
        amount = sum(x[2] for q in queues.values() for x in q)
        shares = {s: sum(x[2] for x in q) / amount for s, q in queues.items()}
        if wanted:
            whole = sum(wanted.get(s, 0.0) for s in queues)
            shares = {s: wanted.get(s, 0.0) / whole for s in queues} if whole else shares
        dealt = np.array(list(deal(queues, shares, carried, window, turn)), np.int64).reshape(-1, 4)
        out = pd.DataFrame(dealt, columns=["row", "start", "length", "sequence_id"])
        out["offset"] = (out["length"].cumsum() - out["length"]) - (out.groupby("sequence_id")["length"].sum().cumsum().shift(fill_value=0).reindex(out["sequence_id"]).to_numpy() if len(out) else 0)
        out["sequence_id"] += p * room
        return out

    pieces = cut.groupBy("part").applyInPandas(windows, "row long, start long, length long, sequence_id long, offset long")
    lists = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    names = ["start", "length", "sequence_id", "offset"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("pieces")
            flat = pa.Table.from_batches([pa.RecordBatch.from_struct_array(found.flatten())])
            parent = np.repeat(np.arange(len(batch)), np.diff(found.offsets.to_numpy()))
            crcs, ids = [], [np.frombuffer(x.as_py(), "<u2").astype("<u4").tobytes() for x in batch.column("ids")]
            for k, start, length in zip(parent.tolist(), flat["start"].to_pylist(), flat["length"].to_pylist(), strict=True):
                crcs.append(zlib.crc32(memoryview(ids[k])[4 * start : 4 * (start + length)]))
            columns = [batch.column("doc_id").take(pa.array(parent)), batch.column("source").take(pa.array(parent)), batch.column("n").take(pa.array(parent)), *[flat[c].combine_chunks() for c in names], pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "doc_tokens", *names, "ids_crc32"])

    met = tokens.join(lists, "row").select("doc_id", "source", "n", "ids", "pieces")
    return met.mapInArrow(giving_back(digests), "doc_id long, source string, doc_tokens long, start long, length long, sequence_id long, offset long, ids_crc32 long")
