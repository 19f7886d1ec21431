"""Catalog of jurisdictions: matching to a gazetteer, merging catalogs, counts and relevance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import Workspace
from .changes import clamp, keep_first, page, where_given

SIMILAR = 0.85
#: Tokens are counted by so many buckets of their hashes when token sets are put in order.
BUCKETS = 1 << 21


def match_exact(left: DataFrame, right: DataFrame, keys: list[str], *order: Column, how: str = "inner") -> DataFrame:
    """Strategy 1: equal keys; of several right rows with a key the last one in `order` counts (without an order, all do). The last
    rows are partially aggregated, so a key of any size is no single task's."""
    if order:
        rest = F.struct(*[F.col(c) for c in right.columns if c not in keys])
        right = right.groupBy(*keys).agg(F.max_by(rest, F.struct(*order)).alias("__last")).select(*keys, "__last.*")
    return left.join(right, keys, how)


def match_name(left: DataFrame, right: DataFrame, block: str, name: str, key: str, kind: str, preferred: list[str], order: str) -> DataFrame:
    """Strategy 2: equal normalised names in one block; of several, a preferred kind, then the first. The best right row of each name
    is taken before the join, so a name that many rows of both sides have doesn't pair them all."""
    best = F.struct(F.when(F.col(kind).isin(preferred), 0).otherwise(1), F.col(order))
    rest = F.struct(*[F.col(c) for c in right.columns if c not in (block, name)])
    firsts = right.groupBy(block, name).agg(F.min_by(rest, best).alias("__first")).select(block, name, "__first.*")
    return keep_first(left.join(firsts, [block, name]), [key], F.when(F.col(kind).isin(preferred), 0).otherwise(1), F.col(order))


def _members(rows: DataFrame, block: str, tokens: str, key: str) -> DataFrame:
    """(block, __key, __set, __sid): each row's distinct tokens in order, and their SHA-256, which stands for the set.

    Rows without a block or tokens match nothing.
    """
    own = rows.where(F.col(block).isNotNull() & F.col(tokens).isNotNull())
    own = own.select(F.col(block), F.col(key).alias("__key"), F.sort_array(F.array_distinct(F.array_compact(tokens))).alias("__set"))
    return own.withColumn("__sid", F.sha2(F.to_json("__set"), 256))


def _token_sets(members: DataFrame, block: str) -> DataFrame:
    """(block, __sid, first, n): one row for each distinct token set of a block, its first key and how many rows have it, so
    copies never pair with each other."""
    return members.groupBy(block, "__sid").agg(F.min("__key").alias("first"), F.count(F.lit(1)).alias("n"))


def _levels(members: list[DataFrame]) -> np.ndarray:
    """Of each bucket of token hashes about the logarithm of how many tokens of all sets fall into it: BUCKETS bytes, whatever the
    tables hold. Tokens are counted by bucket, so that a rare one seldom counts for more than a few others."""
    tokens = reduce(DataFrame.unionByName, [m.select(F.explode("__set").alias("token")) for m in members])
    counts = tokens.groupBy(F.xxhash64("token").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("held"))
    found = counts.select("bucket", F.least(F.floor(F.log2(F.col("held") + 1.0) * 3), F.lit(127)).cast("tinyint").alias("level")).toArrow()
    levels = np.zeros(BUCKETS, np.int64)
    levels[found.column("bucket").to_numpy()] = found.column("level").to_numpy()
    return levels.astype(np.uint8)


def _prefixes(members: DataFrame, levels: Broadcast, block: str, least: float) -> DataFrame:
    """(block, id, n, prefix) of each distinct set of a block; its id is its first row's key.

    A token stands as one number, its bucket's level above bits of its hash; these numbers put tokens in one global order,
    with common ones last. Tokens with equal numbers count as equal here, which can add candidates but lose none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("hashes")
            offsets = column.offsets.to_numpy()
            hashes = column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
            n = np.diff(offsets)
            numbers = levels.value[hashes & np.uint64(BUCKETS - 1)].astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((numbers, row))
            first = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
            at = np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], n)
            ends = np.concatenate([[0], np.cumsum(np.minimum(first, n))]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers[order[at < np.repeat(first, n)]].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n.astype(np.int32)), prefix], names=[*batch.schema.names[:3], "n", "prefix"])

    rows = members.select(block, "__sid", "__key", F.transform("__set", lambda t: F.xxhash64(t)).alias("hashes"))
    own = rows.mapInArrow(run, T.StructType([*rows.schema[:3], T.StructField("n", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType()))]))
    return own.groupBy(block, "__sid").agg(F.min_by(F.struct(F.col("__key").alias("id"), "n", "prefix"), "__key").alias("s")).select(block, "s.*")


def similar_sets(ws: Workspace, left: DataFrame, right: DataFrame | None, block: str, least: float = SIMILAR) -> DataFrame:
    """(block, l_id, r_id, score) for pairs of different sets of one block with Jaccard similarity `least` or more; an id is the
    key of the set's first row. `left` and `right` are staged _members(). Without `right`, pairs within `left`, each both ways.

    Sets of n tokens that reach the threshold share one of the first n - ceil(least * n) + 1 tokens of both in any common
    order, so pairs come from an equi join on (block, such a token) of narrow rows: an id, a size and a place. Sizes prune;
    places do, as sets that have a common token at places apart must differ before or behind it; and so does the number of
    tokens that a pair's beginnings share, as the longer end is all that can be common besides. No pair is lost. Whole
    sets meet at the end, those of candidates only.
    """
    sides = [left] if right is None else [left, right]
    levels = left.sparkSession.sparkContext.broadcast(_levels(sides))
    begun = [ws.stage(_prefixes(side, levels, block, least), f"prefixes-{i}") for i, side in enumerate(sides)]

    def prefix(df: DataFrame, side: str) -> DataFrame:
        return df.select(block, F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"), F.posexplode("prefix").alias(f"{side}_at", "token"))

    pairs = prefix(begun[0], "l").join(prefix(begun[-1], "r"), [block, "token"])
    if right is None:
        pairs = pairs.where("l_id < r_id")
    small, large, both = F.least("l_n", "r_n"), F.greatest("l_n", "r_n"), F.col("l_n") + F.col("r_n")
    apart = F.abs(F.col("l_at") - F.col("r_at")) + F.abs(F.col("l_n") - F.col("l_at") - F.col("r_n") + F.col("r_at"))
    pairs = pairs.where((small >= F.lit(least) * large - 1e-6) & (apart <= F.lit((1 - least) / (1 + least)) * both + 1e-6))
    # the sizes as one number, since all these rows are shuffled
    pairs = pairs.groupBy(block, "l_id", "r_id").agg(F.count(F.lit(1)).alias("shared"), F.min(F.shiftleft(F.col("l_n").cast("long"), 32) + F.col("r_n")).alias("sizes"))
    pairs = pairs.withColumn("l_n", F.shiftright("sizes", 32)).withColumn("r_n", F.col("sizes").bitwiseAND(F.lit((1 << 32) - 1)))
    enough = F.lit(least / (1 + least)) * both - 1e-6  # common tokens of a pair that reaches the threshold
    pairs = ws.stage(pairs.where(F.col("shared") + F.ceil(F.lit(least) * large - 1e-9) - 1 >= enough).select(block, "l_id", "r_id"), "candidates")
    ids = [pairs.select(block, F.col(f"{side}_id").alias("__key")) for side in "lr"]
    ids = [ids[0].unionByName(ids[1])] if right is None else ids
    sets = [ws.stage(df.join(ws.stage(found.distinct(), f"ids-{i}"), [block, "__key"], "left_semi").select(block, "__key", "__set"), f"sets-{i}") for i, (df, found) in enumerate(zip(sides, ids, strict=True))]
    for side, df in (("l", sets[0]), ("r", sets[-1])):
        pairs = pairs.join(df.select(block, F.col("__key").alias(f"{side}_id"), F.col("__set").alias(f"{side}_set")), [block, f"{side}_id"])
    common = F.size(F.array_intersect("l_set", "r_set"))
    score = common / (F.size("l_set") + F.size("r_set") - common)
    found = ws.stage(pairs.select(block, "l_id", "r_id", score.alias("score")).where(F.col("score") >= least), "similar")
    if right is None:
        found = found.unionByName(found.select(block, F.col("r_id").alias("l_id"), F.col("l_id").alias("r_id"), "score"))
    return found


def match_fuzzy(left: DataFrame, right: DataFrame, block: str, tokens: str, key: str, order: str, least: float = SIMILAR) -> DataFrame:
    """Strategy 3: (key, match, score), the largest Jaccard similarity of token sets in the block, ties by `order`."""
    ws = Workspace(left.sparkSession, "fuzzy")
    members, others = ws.stage(_members(left, block, tokens, key), "left"), ws.stage(_members(right, block, tokens, order), "right")
    sets = _token_sets(members, block)
    pairs = similar_sets(ws, members, others, block, least)
    best = keep_first(pairs, [block, "l_id"], F.col("score").desc(), F.col("r_id"))
    owners = members.select(block, "__key", "__sid").join(sets.withColumnRenamed("first", "l_id"), [block, "__sid"])
    return owners.join(best, [block, "l_id"]).select(F.col("__key").alias(key), F.col("r_id").alias("match"), "score")


def match_fuzzy_self(rows: DataFrame, block: str, tokens: str, key: str, least: float = SIMILAR) -> DataFrame:
    """(key, match, score): each row's most similar other row of its block, ties by key.

    Rows with equal sets match the first of them (the first one the second); only the others are compared by pairs. Keys
    must be unique.
    """
    ws = Workspace(rows.sparkSession, "fuzzy")
    members = ws.stage(_members(rows, block, tokens, key), "members")
    sets = ws.stage(_token_sets(members, block), "sets")
    copies = members.select(block, "__key", "__sid").join(sets.where("n > 1"), [block, "__sid"])
    second = copies.where("__key != first").groupBy(block, "__sid").agg(F.min("__key").alias("second"))
    twins = copies.join(second, [block, "__sid"]).select("__key", F.when(F.col("__key") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("match"), F.lit(1.0).alias("score"))
    pairs = similar_sets(ws, members, None, block, least)
    lone = sets.where("n = 1").select(block, F.col("first").alias("l_id"))
    alone = keep_first(pairs.join(lone, [block, "l_id"], "left_semi"), [block, "l_id"], F.col("score").desc(), F.col("r_id")).select(F.col("l_id").alias("__key"), F.col("r_id").alias("match"), "score")
    return twins.unionByName(alone).withColumnRenamed("__key", key)


def cascade(left: DataFrame, key: str, stages: list[tuple[str, callable]]) -> DataFrame:
    """(key, match, strategy) by the first strategy that finds one; each works on what the ones before left over.

    A stage takes the rest and returns (key, match).
    """
    found, rest = [], left
    for name, stage in stages:
        hits = stage(rest).select(key, "match").withColumn("strategy", F.lit(name))
        found.append(hits)
        rest = rest.join(hits.select(key), key, "left_anti")
    found.append(rest.select(key, F.lit(None).cast("string").alias("match"), F.lit("unmatched").alias("strategy")))
    return reduce(DataFrame.unionByName, found)


def match_catalog(left: DataFrame, right: DataFrame, key: str, block: str, name: str) -> DataFrame:
    """(key, match, strategy) by equal keys, then equal whole names in the block, then the most similar token set there.

    Names are normalised, with one space between tokens; `right` has its keys in a column `key` as well. Of several rows
    with a name the first one is taken. Empty and null names and null blocks match by key only.
    """
    named = right.where(F.col(name) != "").select(F.col(key).alias("__match"), block, name)

    def by_key(rest: DataFrame) -> DataFrame:
        return match_exact(rest, right.select(key).distinct(), [key]).withColumn("match", F.col(key).cast("string"))

    def by_name(rest: DataFrame) -> DataFrame:
        best = named.groupBy(block, name).agg(F.min("__match").cast("string").alias("match"))
        return match_exact(rest.where(F.col(name) != ""), best, [block, name])

    def by_tokens(rest: DataFrame) -> DataFrame:
        tokens = lambda df: df.withColumn("__tokens", F.split(name, " "))
        found = match_fuzzy(tokens(rest.where(F.col(name) != "")), tokens(named), block, "__tokens", key, "__match")
        return found.withColumn("match", F.col("match").cast("string"))

    return cascade(left, key, [("key", by_key), ("name", by_name), ("fuzzy", by_tokens)])


def stats(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, key, n): one-dimensional counts and the total in one pass over the rows; null keys aren't counted."""
    pairs = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions]
    total = F.struct(F.lit("total").alias("dimension"), F.lit("").alias("key"))
    return rows.select(F.explode(F.array(*pairs, total)).alias("p")).where("p.key is not null").groupBy("p.dimension", "p.key").agg(F.count(F.lit(1)).alias("n"))


def listing(rows: DataFrame, cached: DataFrame, key: str, only_cached: bool = False, name: str | None = None, limit: int | None = None, offset: int = 0, **equal) -> DataFrame:
    """A page of the catalog: all cached rows, or those whose name contains a text, or those that meet the given filters.

    status becomes 'cached' where a usable cached artifact exists; a row that only claims so is 'available'. Cached listings
    aren't paged.
    """
    found = where_given(rows, **equal)
    if name:
        found = found.where(F.contains(F.lower("name"), F.lit(name.lower())))
    marked = found.join(cached.select(key).distinct().withColumn("__cached", F.lit(True)), key, "left")
    status = F.when(F.col("__cached"), "cached").when(F.col("status") == "cached", "available").otherwise(F.col("status"))
    marked = marked.withColumn("status", status)
    if only_cached:
        return marked.where("__cached").drop("__cached")
    return page(marked.drop("__cached"), clamp("list", limit), offset, F.col(key))


def by_precedence(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union in which an earlier source's row wins over later ones with its key."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    return keep_first(reduce(DataFrame.unionByName, ranked), [key], F.col("source_rank"), F.col(order))


def merge_unscanned(new: DataFrame, old: DataFrame, key: str, scanned: Column) -> DataFrame:
    """The new scan, and old rows outside what was scanned that it doesn't have."""
    return new.unionByName(old.where(~scanned).select(*new.columns).join(new.select(key), key, "left_anti"))


def merge_keep(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The new rows, with `columns` of the old row where it has them."""
    kept = old.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = new.join(kept, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in new.columns])


def in_box(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside the box, edges included; rows without a position aren't."""
    return lat.between(south, north) & lng.between(west, east)

