"""SimHash near-duplicate groups by bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import giving_back
from .common import LAST_ID, Workspace, join_unique

#: Fingerprints that differ in at most RADIUS bits are linked.
RADIUS = 3
SHINGLE, SEED = 3, 42
#: Fingerprints of one bucket that a task compares with each other; larger buckets are compared in pairs of such parts.
BUCKET_PART = 4096
#: Rows that a task compares at once, and (row, block) pairs in flight.
RUN_ROWS, RUN_PAIRS = 1 << 16, 1 << 17

_ALL = np.uint64(2**64 - 1)
_ONES = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash (signed) of the text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, and the six white-space characters
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: -SHINGLE] + 1])
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """id (null doc_id: LAST_ID), text_hash and fp of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())], names=["id", "text_hash", "fp"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), text_hash().alias("text_hash"), "text").mapInArrow(giving_back(run), "id long, text_hash long, fp long")


def bucket_keys(blocks: int) -> Column:
    """Keys of a fingerprint in `blocks` blocks of bits: RADIUS differing bits leave blocks - RADIUS of them equal, so there
    is a key for each choice of that many blocks, and any two linked fingerprints share one."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - RADIUS)):
        key = F.lit(number).cast("long")
        for b in chosen:
            width = edges[b + 1] - edges[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(F.col("fp"), edges[b]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def close_groups(group: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """For each row the number of the first row of its component, linking rows of one group within RADIUS bits.

    Rows are sorted by group. Blocks of 64 rows are stored as 64 vertical bit planes (one word a bit, one lane a row). A
    row meets the blocks of its group at and after its own: each plane, inverted where the row has the bit, marks the
    lanes that differ there; two counter words take the marks as a carry-save adder, and a third keeps the lanes that
    went over RADIUS (3 = what two counter bits hold). Every eight planes, (row, block) pairs whose lanes are all over
    are abandoned.
    """
    n = len(fp)
    blocks = -(-n // 64)
    padded = np.zeros(blocks * 64, np.uint64)
    padded[:n] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, 8), axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64).reshape(64, blocks)
    last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
    end = (last + 1)[np.searchsorted(last, np.arange(n))]
    root = np.arange(n)
    rows = np.flatnonzero(end > np.arange(n) + 1)
    meets = (end[rows] - 1) // 64 - rows // 64 + 1
    upto = np.cumsum(meets)
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + RUN_PAIRS, "right")))
        r, m = rows[at:stop], meets[at:stop]
        q = np.repeat(r, m)
        block = q // 64 + np.arange(len(q)) - np.repeat(np.cumsum(m) - m, m)
        low, high = np.clip(q + 1 - 64 * block, 0, 64), np.clip(end[q] - 64 * block, 0, 64)
        over = ~(_ONES[high] & ~_ONES[low])
        one, two, f = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64), fp[q]
        for bit in range(64):
            if bit % 8 == 0:
                alive = over != _ALL
                if not alive.all():
                    q, block, over, one, two, f = (x[alive] for x in (q, block, over, one, two, f))
                if not len(q):
                    break
            mark = planes[bit][block] ^ (np.uint64(0) - ((f >> np.uint64(bit)) & np.uint64(1)))
            carry = one & mark
            one ^= mark
            over |= two & carry
            two ^= carry
        near = np.flatnonzero(over != _ALL)
        for i in range(0, len(near), 1 << 14):
            part = near[i : i + (1 << 14)]
            lanes = np.unpackbits((~over[part]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(lanes)
            _join(root, q[part][k], 64 * block[part][k] + lane)
        at = stop
    return root


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i]; root[x] is the smallest row of x's component."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def links(ws: Workspace, prints: DataFrame, bucket_part: int = BUCKET_PART) -> DataFrame:
    """Edges (u, v), u > v, that span the components of the distinct fingerprints in `prints` (staged; column fp)."""
    n = prints.count()
    # more, narrower choices as the table grows: buckets stay at about a block of 64 rows
    blocks = 4 if n <= 1 << 22 else 5 if n <= 1 << 30 else 6
    keyed = ws.stage(prints.select("fp", F.explode(bucket_keys(blocks)).alias("bucket")), "buckets")
    large = ws.stage(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_part), "large")
    met = join_unique(keyed, large, ["bucket"], "n").withColumn("parts", F.coalesce(F.ceil(F.col("n") / bucket_part), F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
    # a row of a large bucket goes to each pair of parts that has its own
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: (F.col("parts") == 1) | (j != mine))
    dealt = met.select("bucket", "fp", mine.alias("mine"), F.explode(others).alias("other"))
    dealt = dealt.select("bucket", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp")
    dealt = dealt.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def run(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            table = np.concatenate(held)
            change = np.flatnonzero((table[1:, :3] != table[:-1, :3]).any(1)) + 1
            cut = len(table) if final else int(change[-1]) if len(change) else 0
            held, rows = [table[cut:]], len(table) - cut
            if cut:
                group = np.zeros(cut, np.int64)
                group[change[change < cut]] = 1
                fp = np.ascontiguousarray(table[:cut, 3]).view(np.uint64)
                root = close_groups(np.cumsum(group), fp)
                child = np.flatnonzero(root != np.arange(cut))
                if len(child):
                    u, v = fp[child].view(np.int64), fp[root[child]].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("bucket", "a", "b", "fp")], axis=1))
            rows += len(batch)
            if rows >= RUN_ROWS:
                yield from run(False)
        if rows:
            yield from run(True)

    return dealt.mapInArrow(compare, "u long, v long").distinct()


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of `edges` (u > v), by alternating large and small stars.

    Each round is staged; rounds grow with the logarithm of the longest chain. Neighbours of a hub are never gathered:
    minima are partially aggregated, and a hub's edges are joined by broadcast of its minimum (join_unique).
    """
    edges, number = ws.stage(edges, "edges-0"), 0
    mark = None
    while True:
        both = ws.stage(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), f"both-{number}")
        least = ws.stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), f"least-{number}")
        large = ws.stage(join_unique(both, least, ["u"], "n", "inner").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large-{number}")
        small = ws.stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"small-{number}")
        moved = join_unique(large, small, ["u"], "n", "inner").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        number += 1
        edges = ws.stage(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), f"edges-{number}")
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first()
        if new == mark:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        mark = new


def near_groups(docs: DataFrame, bucket_part: int = BUCKET_PART) -> DataFrame:
    """doc_id, text_hash, fp (64 bits as a signed long) and component_id, the smallest doc_id reachable over links, for every document.

    Defined cases: null and empty texts have fingerprint 0, which is linked like any other; null doc_ids come after all
    others (component_id is null where a component has no other); repeated rows share a component; texts of fewer words
    than a shingle count as one shingle; an empty table gives no rows; other columns are not read.

    Links are searched among distinct fingerprints, so copies of any number cost one row; components are found on
    fingerprints too and reach the documents by a join that withstands hot fingerprints.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    marked = ws.stage(fingerprints(docs), "fingerprints")
    prints = ws.stage(marked.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = ws.stage(components(ws, links(ws, prints, bucket_part)), "roots")
    rooted = ws.stage(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    heads = ws.stage(rooted.groupBy("root").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("prints")), "heads")
    classes = ws.stage(join_unique(rooted.select("root", "fp", "n"), heads, ["root"], "prints", "inner").select("fp", "head", "n"), "classes")
    given = lambda c: F.when(F.col(c) != LAST_ID, F.col(c)).alias(c)
    return join_unique(marked, classes, ["fp"], "n", "inner").select(given("id").alias("doc_id"), "text_hash", "fp", given("head").alias("component_id"))


def keep_one(docs: DataFrame, bucket_part: int = BUCKET_PART) -> DataFrame:
    """The documents of `docs` that have the smallest doc_id of their component.

    Rows are dropped by doc_id and text, so of rows that share a doc_id those with another text stay, and rows that repeat
    both stay or go together. A component without any doc_id stays whole. Null texts count as empty; other columns pass
    through, whatever their names.
    """
    groups = near_groups(docs.select("doc_id", "text"), bucket_part)
    gone = groups.where("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (text_hash("row.text") == F.col("gone_hash")), "left_anti").select("row.*")
