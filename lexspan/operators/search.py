"""Phrase search: a query is an AND of phrases, each of which may occur in any searched column; case and accents don't matter.

PhraseIndex keeps an inverted index in step with a table, so searches read the postings of their tokens and no text;
matches() and holds() are the same predicate on a table without an index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import search_text, token_pieces
from ..snapshots import Snapshots
from ..staging import Workspace

#: Changes with the layout of an index's files.
LAYOUT = 1
SNIPPET_TOKENS = 20
ELLIPSIS = "..."


def phrases(query: str) -> list[str]:
    """Phrases of a query text: its pieces between white space. Punctuation inside a piece makes it several words in a row."""
    return query.split()


def holds(columns: list[Column], phrase: Column) -> Column:
    """The normalised phrase occurs, on token boundaries, in one of the normalised columns; a phrase without tokens never does."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    hit = reduce(Column.__or__, [F.contains(pad(F.coalesce(c, F.lit(""))), pad(phrase)) for c in columns])
    return (phrase != "") & hit


def matches(query: str, *columns: str) -> Column:
    """Predicate for a literal query; a blank query matches nothing."""
    found = phrases(query)
    if not found:
        return F.lit(False)
    return reduce(Column.__and__, [holds([search_text(F.col(c)) for c in columns], search_text(F.lit(p))) for p in found])


def snippet(text: Column, phrase: Column, tokens: int = SNIPPET_TOKENS) -> Column:
    """At most `tokens` tokens of the text as it is written, from the phrase's first occurrence on (from the start if it isn't
    there), with an ellipsis where text was left out."""
    words, pieces = search_text(text), token_pieces(text)
    at = F.instr(F.concat(F.lit(" "), words, F.lit(" ")), F.concat(F.lit(" "), search_text(phrase), F.lit(" ")))
    before = F.when(at > 1, F.size(F.split(F.left(words, at - 1), " ")) - 1).otherwise(0)
    window = F.array_join(F.slice(pieces, before + 1, tokens), "")
    head = F.when(before > 0, ELLIPSIS).otherwise(F.regexp_extract(text, r"^[^\p{L}\p{N}]*", 0))
    tail = F.size(pieces) > before + tokens
    return F.concat(head, F.when(tail, F.regexp_replace(window, r"[^\p{L}\p{N}\p{M}]+$", "")).otherwise(window), F.when(tail, ELLIPSIS).otherwise(""))


def search(rows: DataFrame, query: str, columns: list[str], limit: int, *order: Column) -> DataFrame:
    return rows.where(matches(query, *columns)).orderBy(*order).limit(max(limit, 0))


def _words(spark: SparkSession, query: str) -> list[list[str]]:
    """Token lists of a literal query's phrases; none if it is blank or a phrase has no token."""
    pieces = phrases(query)
    words = spark.sql("select 1").select(F.array(*[F.split(search_text(F.lit(p)), " ") for p in pieces])).first()[0] if pieces else []
    return [] if [""] in words else words


class _Block:
    """Postings of some documents that follow each other in a partition."""

    def __init__(self, number: int):
        self.number, self.docs, self.size = number, 0, 0
        self.held: dict[str, list] = {}

    def add(self, at: int, field: int, text: str) -> None:
        places: dict[str, list[int]] = {}
        for place, token in enumerate(text.split(" ")):
            places.setdefault(token, []).append(place)
            self.size += 1
        for token, found in places.items():
            self.held.setdefault(token, []).append((at, field, found))

    def rows(self) -> Iterator[pa.RecordBatch]:
        tokens = sorted(self.held)
        for k in range(0, len(tokens), 50_000):
            some = tokens[k : k + 50_000]
            each = [self.held[t] for t in some]
            flat = [x for found in each for x in found]
            bounds = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(list(sizes), dtype=np.int64)]).astype(np.int32))
            places = pa.ListArray.from_arrays(bounds(len(x[2]) for x in flat), pa.array([p for x in flat for p in x[2]], pa.int32()))
            docs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int8()), places], ["d", "f", "p"])
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.string()), pa.array([self.number] * n, pa.int64()), pa.array(map(len, each), pa.int32()), pa.array((x[0][0] for x in each), pa.int32()), pa.array((x[-1][0] for x in each), pa.int32()),
                 pa.ListArray.from_arrays(bounds(map(len, each)), docs), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int8()), pa.nulls(n, pa.list_(pa.int32()))], names=_STAGED)


_STAGED = ["token", "block", "n", "low", "high", "docs", "num", "f", "starts"]
_POSTINGS = "token string, block long, n int, low int, high int, docs array<struct<d: int, f: tinyint, p: array<int>>>"
#: Documents and tokens of a block of postings, beyond which a new one begins.
BLOCK_DOCS, BLOCK_TOKENS = 1024, 1_000_000


def _post(fields: int):
    """Rows (num, t<field>: normalised text, l<field>: lengths of its pieces as written, o<field>: what comes before them) to blocks of
    postings, and a row for each document and field with the places where its tokens start."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            nums = batch.column("num").to_pylist()
            texts = [batch.column(f"t{f}").to_pylist() for f in range(fields)]
            for i, num in enumerate(nums):
                if block is None or block.docs >= BLOCK_DOCS or block.size >= BLOCK_TOKENS:
                    if block:
                        yield from block.rows()
                    block = _Block(num)
                for f in range(fields):
                    if texts[f][i]:
                        block.add(num - block.number, f, texts[f][i])
                block.docs += 1
            for f in range(fields):
                lengths = batch.column(f"l{f}").fill_null(pa.scalar([], pa.list_(pa.int32())))
                sizes, ends = lengths.flatten().to_numpy(), lengths.offsets.to_numpy() - lengths.offsets[0].as_py()
                lead = batch.column(f"o{f}").fill_null(0).to_numpy(zero_copy_only=False)
                before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                # a piece starts after the lead and the pieces before it in its text
                starts = before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends)) + np.repeat(lead, np.diff(ends))
                n = len(nums)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.int32()) for _ in range(3)), pa.nulls(n, pa.list_(pa.struct([("d", pa.int32()), ("f", pa.int8()), ("p", pa.list_(pa.int32()))]))),
                     pa.array(nums, pa.int64()), pa.array([f] * n, pa.int8()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(starts.astype(np.int32)))], names=_STAGED)
        if block:
            yield from block.rows()

    return posted


class PhraseIndex:
    """An inverted index below a folder, in step with a table of documents.

    A row of `postings` has a token's places in a block of documents: for each the distance from the block's first number,
    the field and the places, with the least and the largest distance. Blocks hold BLOCK_DOCS documents at most and are
    the same for all tokens, so phrases meet by block, no common word's places are in one row or task, and blocks
    without all tokens go before any place is read. Rows are range-sorted by token, so a search reads a few row groups. `docs` has
    each document's number, key and the characters where its tokens start, so a snippet is cut by substrings. Parquet's
    delta encoding packs numbers, places and starts.

    build(), refresh() and compact() write new folders and commit them as one state of Snapshots: a stopped writer leaves the
    state before, of two writers at once the second gets Conflict, and a search reads one state throughout. Whoever knows
    the path shares the index. refresh() adds what changed as a generation and names the numbers that are dead now; compact()
    takes these out. Null texts and texts without tokens have no postings; keys must be unique and not null.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.snapshots = spark, Snapshots(spark, path)

    def exists(self) -> bool:
        return self.snapshots.state()["number"] > 0

    # -- writing

    def _generation(self, rows: DataFrame, key: str, fields: list[str], gen: int) -> dict[str, dict]:
        """New folders with the documents of `rows`: table name -> entry."""
        ws = Workspace(self.spark, "index")
        try:
            pieces = {f: token_pieces(F.col(c)) for f, c in enumerate(fields)}
            given = [x for f, c in enumerate(fields) for x in (search_text(F.col(c)).alias(f"t{f}"), F.transform(pieces[f], F.length).alias(f"l{f}"), F.length(F.regexp_extract(F.col(c), r"^[^\p{L}\p{N}]*", 0)).alias(f"o{f}"))]
            # a table of a few row groups is dealt out first, else few tasks would do all the work
            few = rows.rdd.getNumPartitions() < self.spark.sparkContext.defaultParallelism
            rows = rows.repartition(self.spark.sparkContext.defaultParallelism) if few else rows
            numbered = ws.stage(rows.select(F.monotonically_increasing_id().alias("num"), F.col(key).alias("key"), *[F.col(c) for c in fields]), "rows")
            kind = f"{_POSTINGS}, num long, f tinyint, starts array<int>"
            made = ws.stage(numbered.select("num", *given).mapInArrow(_post(len(fields)), kind), "made")
            blocks = made.where("token is not null").select(F.lit(gen).alias("gen"), *[c for c in _STAGED[:6]])
            docs = made.where("num is not null").select(F.lit(gen).alias("gen"), "num", "f", "starts").join(numbered.select("num", "key"), "num")
            packed = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(16 << 20), "compression": "zstd"}
            plain = {"parquet.enable.dictionary#docs.list.element.p.list.element": "false", "parquet.enable.dictionary#starts.list.element": "false"}
            return {
                "postings": {"at": self.snapshots.write(blocks.repartitionByRange("token", "block").sortWithinPartitions("token", "block"), "postings", **packed, **plain), "gen": gen},
                "docs": {"at": self.snapshots.write(docs.select("gen", "num", "f", "key", "starts").repartitionByRange("num").sortWithinPartitions("num", "f"), "docs", **packed, **plain), "gen": gen},
            }
        finally:
            ws.drop()

    def build(self, rows: DataFrame, key: str, columns: list[str]) -> PhraseIndex:
        """The index anew, whatever was there."""
        base = self.snapshots.state()
        made = self._generation(rows, key, columns, 0)
        self.snapshots.commit(base, {k: [e] for k, e in made.items()} | {"dead": []}, {"fields": columns, "key": rows.schema[key].dataType.simpleString(), "gen": 0})
        return self

    def refresh(self, changed: DataFrame, gone: DataFrame, key: str, columns: list[str]) -> PhraseIndex:
        """Take in new and changed rows (whole rows) and forget the keys in `gone`, in one commit."""
        base = self.snapshots.state()
        if columns != base["facts"]["fields"]:
            raise ValueError(f"the index is of {base['facts']['fields']}")
        keys = changed.select(F.col(key).alias("key")).unionByName(gone.select(F.col(key).alias("key"))).distinct()
        dead = self._docs(base).select("gen", "num", "key").distinct().join(keys, "key", "left_semi").select("gen", "num")
        entries = [{"at": self.snapshots.write(dead, "dead")}]
        gen = base["facts"]["gen"] + 1
        made = self._generation(changed, key, columns, gen)
        self.snapshots.commit(base, {k: [*base["tables"][k], e] for k, e in made.items()} | {"dead": [*base["tables"]["dead"], *entries]}, {"gen": gen})
        return self

    def compact(self, path: str | None = None) -> PhraseIndex:
        """One set of files without dead documents, here (the state before stays until vacuum) or below another path."""
        base = self.snapshots.state()
        new = self if path is None else PhraseIndex(self.spark, path)
        # numbers of dead documents by block: as many as a block has documents at most
        dead = self._dead(base)
        rows = self._postings(base)
        blocks = rows.select("gen", "block").distinct()
        of_block = dead.join(blocks, "gen").where("num >= block").groupBy("gen", "num").agg(F.max("block").alias("block")).groupBy("gen", "block").agg(F.collect_list((F.col("num") - F.col("block")).cast("int")).alias("gone"))
        kept = F.filter("docs", lambda x: ~F.coalesce(F.array_contains("gone", x["d"]), F.lit(False)))
        live = rows.join(of_block, ["gen", "block"], "left").withColumn("docs", kept).where(F.size("docs") > 0)
        live = live.select("gen", "token", "block", F.size("docs").alias("n"), F.element_at("docs", 1)["d"].alias("low"), F.element_at("docs", -1)["d"].alias("high"), "docs")
        packed = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(16 << 20), "compression": "zstd"}
        tables = {
            "postings": [{"at": new.snapshots.write(live.repartitionByRange("token", "gen", "block").sortWithinPartitions("token", "gen", "block"), "postings", **packed)}],
            "docs": [{"at": new.snapshots.write(self._docs(base).repartitionByRange("gen", "num").sortWithinPartitions("gen", "num", "f"), "docs", **packed)}],
            "dead": [],
        }
        new.snapshots.commit(new.snapshots.state() if path else base, tables, base["facts"])
        return new

    # -- reading

    def _postings(self, state: dict) -> DataFrame:
        return self.snapshots.read((e["at"] for e in state["tables"]["postings"]), f"gen int, {_POSTINGS}")

    def _dead(self, state: dict) -> DataFrame:
        return self.snapshots.read((e["at"] for e in state["tables"]["dead"]), "gen int, num long")

    def _docs(self, state: dict) -> DataFrame:
        """Documents that count: gen, num, f, key and the starts of the field's tokens."""
        rows = self.snapshots.read((e["at"] for e in state["tables"]["docs"]), f"gen int, num long, f tinyint, key {state['facts']['key']}, starts array<int>")
        return rows.join(self._dead(state), ["gen", "num"], "left_anti") if state["tables"]["dead"] else rows

    def find(self, query: str, fields: list[str] | None = None) -> DataFrame:
        """Documents that hold every phrase of a literal query in one of the fields (all by default): key, and the field and place where
        the first phrase stands first. A blank query, or one with a phrase without tokens, finds none."""
        state = self.snapshots.state()
        known = state["facts"]["fields"]
        words = _words(self.spark, query)
        docs = self._docs(state)
        if not words:
            return docs.select("key", "gen", "num", "f", F.lit(0).alias("place")).limit(0)
        tokens = sorted({t for w in words for t in w})
        rows = self._postings(state).where(F.col("token").isin(tokens))
        # only blocks that have all tokens, and there only documents within what all tokens span, are looked into
        near = rows.groupBy("gen", "block").agg(F.count(F.lit(1)).alias("tokens"), F.max("low").alias("from"), F.min("high").alias("to")).where((F.col("tokens") == len(tokens)) & (F.col("from") <= F.col("to"))).drop("tokens")
        inside = rows.join(near, ["gen", "block"])
        met = inside.select("gen", "block", "token", F.explode(F.filter("docs", lambda x: x["d"].between(F.col("from"), F.col("to")))).alias("x"))
        if fields is not None:
            met = met.where(F.col("x.f").isin([known.index(f) for f in fields]))
        by_field = met.groupBy("gen", (F.col("block") + F.col("x.d")).alias("num"), F.col("x.f").alias("f")).agg(*[F.first(F.when(F.col("token") == t, F.col("x.p")), ignorenulls=True).alias(f"p{k}") for k, t in enumerate(tokens)])

        def moved_back(places: Column, by: int) -> Column:
            return F.transform(places, lambda p: p - by)

        def starts(phrase: list[str]) -> Column:
            """Places where all the phrase's tokens agree on its start."""
            moved = [moved_back(F.col(f"p{tokens.index(t)}"), j) for j, t in enumerate(phrase)]
            return F.coalesce(reduce(F.array_intersect, moved), F.array().cast("array<int>"))

        held = by_field.select("gen", "num", "f", *[F.array_min(starts(w)).alias(f"s{i}") for i, w in enumerate(words)])
        first = F.min(F.when(F.col("s0").isNotNull(), F.struct("f", F.col("s0").alias("place")))).alias("first")
        hits = held.groupBy("gen", "num").agg(first, *[F.count(f"s{i}").alias(f"h{i}") for i in range(len(words))]).where(reduce(Column.__and__, [F.col(f"h{i}") > 0 for i in range(len(words))]))
        return hits.join(docs.where("f = 0").select("gen", "num", "key"), ["gen", "num"]).select("key", "gen", "num", "first.f", "first.place")

    def sizes(self) -> DataFrame:
        """For each field the documents with tokens and the places of tokens: field, docs, places."""
        state = self.snapshots.state()
        n = F.size("starts")
        names = F.array(*[F.lit(f) for f in state["facts"]["fields"]])
        return self._docs(state).groupBy("f").agg(F.count_if(n > 0).alias("docs"), F.sum(n).alias("places")).select(F.get(names, F.col("f").cast("int")).alias("field"), "docs", "places")

    def snippets(self, hits: DataFrame, rows: DataFrame, key: str, field: str, tokens: int = SNIPPET_TOKENS) -> DataFrame:
        """(key, snippet) of hits that find() gave for one field of `rows`: what snippet() cuts, by substrings of the text."""
        state = self.snapshots.state()
        number = state["facts"]["fields"].index(field)
        begun = self._docs(state).where(F.col("f") == number).select("gen", "num", "starts").join(hits.select("gen", "num", "place"), ["gen", "num"])
        cut = begun.select("gen", "num", "place", F.get("starts", F.lit(0)).alias("lead"), F.get("starts", F.col("place")).alias("a"), F.get("starts", F.col("place") + tokens).alias("b"))
        text = rows.select(F.col(key).alias("key"), F.col(field).alias("text"))
        met = hits.select("key", "gen", "num").join(cut, ["gen", "num"]).join(text, "key")
        tail = F.col("b").isNotNull()
        window = F.when(tail, F.regexp_replace(F.substr("text", F.col("a") + 1, F.col("b") - F.col("a")), r"[^\p{L}\p{N}\p{M}]+$", "")).otherwise(F.substr("text", F.col("a") + 1))
        head = F.when(F.col("place") > 0, ELLIPSIS).otherwise(F.left("text", F.col("lead")))
        return met.select("key", F.concat(head, window, F.when(tail, ELLIPSIS).otherwise("")).alias("snippet"))

    def find_each(self, asked: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
        """(query, key) for every row of `asked` (query, text) and every row of `rows`, the indexed table, that holds all its phrases.

        A query's candidates are the documents of its rarest token, taken from that token's blocks; what they hold is then
        verified on their texts, each of which is normalised once.
        """
        state = self.snapshots.state()
        ws = Workspace(self.spark, "asked")
        wanted = ws.stage(_wanted(asked), "wanted")
        tokens = ws.stage(wanted.select("query", F.explode(F.array_distinct(F.split(F.array_join("phrases", " "), " "))).alias("token")), "tokens")
        blocks = self._postings(state)
        held = blocks.select("token", "n").join(tokens.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("n").alias("held"))
        # a token that no document has ends its query
        rare = tokens.join(held, "token", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), F.col("token"))).alias("r")).where("r.held > 0").select("query", F.col("r.token").alias("token"))
        near = blocks.select("token", "gen", "block", "docs").join(rare, "token")
        near = near.select("query", "gen", "block", F.explode(F.array_distinct(F.transform("docs", lambda x: x["d"]))).alias("d")).select("query", "gen", (F.col("block") + F.col("d")).alias("num"))
        near = ws.stage(near.join(self._docs(state).where("f = 0").select("gen", "num", "key"), ["gen", "num"]).select("query", "key"), "near")
        return _verified(near, rows, wanted, key, columns)


def _wanted(asked: DataFrame) -> DataFrame:
    pieces = F.transform(F.filter(F.split(F.trim("text"), r"\s+"), lambda p: p != ""), search_text)
    return asked.select("query", F.array_distinct(pieces).alias("phrases")).where((F.size("phrases") > 0) & ~F.array_contains("phrases", ""))


def _verified(near: DataFrame, rows: DataFrame, wanted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The candidates (query, key) that hold all phrases of their queries."""
    texts = rows.select(F.col(key).alias("key"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).join(near.select("key").distinct(), "key", "left_semi")
    texts = texts.select("key", *[search_text(F.col(f"c{i}")).alias(f"t{i}") for i in range(len(columns))])
    met = near.join(texts, "key").join(wanted, "query")
    return met.where(F.forall("phrases", lambda p: holds([F.col(f"t{i}") for i in range(len(columns))], p))).select("query", "key")


def scan_each(asked: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What find_each() gives, for a table without an index: each text is cut into its tokens once, and only tokens that are asked
    for leave the scan."""
    ws = Workspace(rows.sparkSession, "asked")
    wanted = ws.stage(_wanted(asked), "wanted")
    tokens = ws.stage(wanted.select("query", F.explode(F.array_distinct(F.split(F.array_join("phrases", " "), " "))).alias("token")), "tokens")
    every = F.array_distinct(F.split(F.concat_ws(" ", *[search_text(F.col(c)) for c in columns]), " "))
    met = ws.stage(rows.select(F.col(key).alias("key"), F.explode(every).alias("token")).join(tokens.select("token").distinct(), "token", "left_semi"), "met")
    held = met.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    rare = tokens.join(held, "token", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), F.col("token"))).alias("r")).where("r.held > 0").select("query", F.col("r.token").alias("token"))
    near = ws.stage(met.join(rare, "token").select("query", "key"), "near")
    return _verified(near, rows, wanted, key, columns)


def top_per_group(rows: DataFrame, group: str, n: int, limit: int, *order: Column) -> DataFrame:
    """At most n rows of each group and `limit` in all, by group and order."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n").orderBy(group, *order).limit(limit)



#: Rows that search_code() gives where no limit is asked for.
DEFAULT_RESULTS = 10


def search_code(hits: DataFrame, sections: DataFrame, jurisdictions: DataFrame, jurisdiction: str | None = None, code: str | None = None, state: str | None = None, limit: int | None = None) -> DataFrame:
    """The sections that a query found, in one jurisdiction (and code) if it is named, else in all usable ones (of a state): jurisdiction_id,
    name, code_id and key, by jurisdiction and key, `limit` rows at most (10 by default) in all.

    hits: key of the sections found (find(), or a scan). sections: key, jurisdiction_id, code_id. jurisdictions: id, name, state and
    usable. An unknown jurisdiction finds nothing; a code counts within a jurisdiction only.
    """
    rows = jurisdictions.select(F.col("id").alias("jurisdiction_id"), "name", "state", "usable")
    if jurisdiction is not None:
        rows, inside = rows.where(F.col("jurisdiction_id") == jurisdiction), sections.where(F.col("jurisdiction_id") == jurisdiction)
        inside = inside if code is None else inside.where(F.col("code_id") == code)
    else:
        rows, inside = rows.where("usable") if state is None else rows.where(F.col("usable") & (F.lower("state") == state.lower())), sections
    found = inside.join(hits.select("key"), "key", "left_semi").join(rows, "jurisdiction_id")
    return found.select("jurisdiction_id", "name", "code_id", "key").orderBy("jurisdiction_id", "key").limit(max(0, DEFAULT_RESULTS if limit is None else limit))
