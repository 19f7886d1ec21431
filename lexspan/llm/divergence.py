"""How the sources of a language differ in their words, by mergeable radix tries of term counts."""

from __future__ import annotations

import gc
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

#: Distinct (group, term) counts that a task gathers before they go into its tries, and leaves of tries before these are written out.
GATHERED, LEAVES = 500_000, 400_000
#: Bytes of the tries' first step.
HEAD = 3
#: Cells of the tables (terms x sources, pairs of sources) that a task holds at once.
CELLS = 2_000_000
#: Bytes of terms as they are (A-Z lowered); all others part terms. UTF-8 bytes of characters from U+0080 on are all of them terms'.
_TERM = bytes(b if b >= 0x80 or chr(b).isalpha() and chr(b).islower() else b | 0x20 if chr(b).isalpha() else 0x20 for b in range(256))

LEAF = "lang string, term string, df long, sources array<string>, counts array<long>"
FOUND = "lang string, kind int, a string, b string, value long"


class Node:
    __slots__ = ("counts", "df", "kids", "label")

    def __init__(self, label: bytes):
        self.label = label
        self.kids: dict[int, Node] | None = None
        self.counts: dict | None = None
        self.df = 0


class Trie:
    """Byte strings in a radix trie: a node's label is what all strings below it share after its parent's. Where a string ends
    there are its counters, one for each source, and the number of documents; counters of equal strings add up, so tries of
    parts of a corpus merge to the trie of all of it. The first HEAD bytes are one step, taken by a table."""

    def __init__(self):
        self.top: dict[bytes, Node] = {}
        self.leaves = 0

    def node(self, term: bytes) -> Node:
        """The leaf of a string, made where there is none."""
        head = term[:HEAD]
        node = self.top.get(head)
        if node is None:
            node = self.top[head] = Node(head)
        at, end = HEAD, len(term)
        while at < end:
            kids, first = node.kids, term[at]
            if kids is None:
                kids = node.kids = {}
            kid = kids.get(first)
            if kid is None:
                node = kids[first] = Node(term[at:])
                break
            label = kid.label
            if not term.startswith(label, at):
                shared, most = 1, min(len(label), end - at)
                while shared < most and label[shared] == term[at + shared]:
                    shared += 1
                fork = Node(label[:shared])
                fork.kids = {label[shared]: kid}
                kid.label = label[shared:]
                kids[first] = kid = fork
                label = fork.label
            at += len(label)
            node = kid
        if node.counts is None:
            node.counts = {}
            self.leaves += 1
        return node

    def add(self, term: bytes, df: int, counts: dict) -> None:
        node = self.node(term)
        node.df += df
        for source, n in counts.items():
            node.counts[source] = node.counts.get(source, 0) + n

    def merge(self, other: Trie) -> None:
        for term, node in other.walk():
            self.add(term, node.df, node.counts)

    def walk(self) -> Iterator[tuple[bytes, Node]]:
        """All strings with their leaves, in the order of their bytes."""
        # a head shorter than HEAD is a whole string, so heads come in the order of what is below them
        open_ = [(b"", self.top[head]) for head in sorted(self.top, reverse=True)]
        while open_:
            before, node = open_.pop()
            term = before + node.label
            if node.counts is not None:
                yield term, node
            if node.kids:
                open_ += [(term, node.kids[b]) for b in sorted(node.kids, reverse=True)]


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of letters A to Z, lowered, and of all characters from U+0080 on."""
    return text.translate(_TERM).split()


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _leaves(lang: str, found: Iterator[tuple[bytes, Node]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Leaves whose counters are by places in `names`."""
    strings = pa.array(names, pa.string())
    while some := list(islice(found, 20_000)):
        held = [node.counts for _, node in some]
        sources = strings.take(pa.array(np.fromiter(chain.from_iterable(held), np.int64)))
        counts = pa.array(np.fromiter(chain.from_iterable(c.values() for c in held), np.int64))
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        df = pa.array(np.fromiter((node.df for _, node in some), np.int64, len(some)))
        term = pa.array([t for t, _ in some], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), term, df, _lists(sizes, sources), _lists(sizes, counts)], names=["lang", "term", "df", "sources", "counts"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of a task's documents, one for each language, written out in the order of their terms."""
    tries: dict[str, Trie] = defaultdict(Trie)
    counts: dict[str, dict[int, Counter]] = defaultdict(lambda: defaultdict(Counter))
    held: dict[str, Counter] = defaultdict(Counter)
    places: dict[str, int] = {}

    def settle() -> None:
        for lang, by_source in counts.items():
            trie = tries[lang]
            nodes = {}
            df = held[lang]
            for term in sorted(df):  # neighbours share their way down
                node = nodes[term] = trie.node(term)
                node.df += df[term]
            for source, found in by_source.items():
                for term, n in found.items():
                    counters = nodes[term].counts
                    counters[source] = counters.get(source, 0) + n
        counts.clear()
        held.clear()

    def write() -> Iterator[pa.RecordBatch]:
        for lang, trie in tries.items():
            yield from _leaves(lang, trie.walk(), list(places))
        tries.clear()

    gc.disable()  # nodes are many and in no cycles; the collector would walk them all again and again
    for batch in batches:
        rows = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True)
        for k, (lang, source, text) in enumerate(rows):
            found = terms(text.as_py())
            counts[lang][places.setdefault(source, len(places))].update(found)
            held[lang].update(set(found))
            if k % 64 == 63 and sum(len(c) for by_source in counts.values() for c in by_source.values()) >= GATHERED:
                settle()
                if sum(t.leaves for t in tries.values()) >= LEAVES:
                    yield from write()
    settle()
    yield from write()
    gc.enable()


def _merge(least: int):
    """One range of terms: the traversals of all tries come in order, so leaves of the same term are neighbours, whose counters are
    added up; terms that at least `least` documents have are given out."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            rows = pa.Table.from_batches(rest + [batch] if batch else rest).combine_chunks().to_batches()[:1] if rest or batch else []
            if not rows or not len(rows[0]):
                continue
            (rows,) = rows
            begins = np.ones(len(rows), bool)
            lang, term = rows.column("lang"), rows.column("term")
            begins[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
            rest = []
            if batch:  # the last term may go on in the next batch
                last = int(np.flatnonzero(begins)[-1])
                rest, rows, begins = [rows.slice(last)], rows.slice(0, last), begins[:last]
                if not last:
                    continue
            starts, group = np.flatnonzero(begins), np.cumsum(begins) - 1
            df = np.add.reduceat(rows.column("df").to_numpy(), starts)
            kept = df >= least
            if not kept.any():
                continue
            some = rows.filter(pa.array(kept[group]))
            number = (np.cumsum(kept) - 1)[group[kept[group]]]
            sources = some.column("sources").flatten().dictionary_encode()
            width = max(1, len(sources.dictionary))
            cells = np.repeat(number, np.diff(some.column("sources").offsets.to_numpy())) * width + sources.indices.to_numpy()
            order = np.argsort(cells, kind="stable")
            cells = cells[order]
            firsts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            counts = np.add.reduceat(some.column("counts").flatten().to_numpy()[order], firsts)
            sizes = np.bincount(cells[firsts] // width, minlength=int(kept.sum()))
            heads = rows.take(pa.array(starts[kept]))
            yield pa.RecordBatch.from_arrays(
                [heads.column("lang"), heads.column("term"), pa.array(df[kept]), _lists(sizes, sources.dictionary.take(pa.array(cells[firsts] % width))), _lists(sizes, pa.array(counts))], names=["lang", "term", "df", "sources", "counts"]
            )

    return merged


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * counts / whole), exact for counts <= whole < 9 * 10^15."""
    out, rest = np.zeros(np.broadcast(counts, whole).shape, np.int64), counts
    for _ in range(3):
        part, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + part
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Language:
    """What a task finds for a language: sums over pairs of sources, less what a term that neither has would give, and each
    source's leading terms."""

    def __init__(self, lang: str, top: int):
        self.lang, self.top = lang, top
        self.names: list[str] = []
        self.total, self.v = [], 0
        self.pairs: dict[int, np.ndarray] = {}
        self.best: dict[int, list[tuple[int, str]]] = defaultdict(list)
        self.terms: list[str] = []
        self.at: list[tuple[int, int, int]] = []

    def begin(self) -> None:
        self.index = {s: i for i, s in enumerate(self.names)}
        self.whole = np.array(self.total, np.int64) + 2 * self.v
        self.none = shares(np.full(len(self.names), 2, np.int64), self.whole)
        self.all_whole = np.int64(sum(self.total) + 2 * self.v)

    def add(self, term: str, sources: list[str], counts: list[int]) -> None:
        self.at += [(len(self.terms), self.index[s], n) for s, n in zip(sources, counts, strict=True)]
        self.terms.append(term)

    def full(self) -> bool:
        return len(self.terms) * len(self.names) >= CELLS

    def settle(self) -> None:
        if not self.terms:
            return
        row, col, n = np.array(self.at, np.int64).T
        has = np.zeros((len(self.terms), len(self.names)), bool)
        has[row, col] = True
        p = np.tile(self.none, (len(self.terms), 1))
        p[row, col] = shares(n + 2, self.whole[col])
        overall = shares(np.bincount(row, n, len(self.terms)).astype(np.int64) + 2 if n.sum() < 2**53 else np.array([int(n[row == r].sum()) for r in range(len(self.terms))]) + 2, self.all_whole)
        for s in np.unique(col):
            rows = np.flatnonzero(has[:, s])
            mine = p[rows, s]
            value = distance(mine[:, None], p[rows]) - distance(self.none[s], self.none)
            value[:, :s][has[rows, :s]] = 0  # counted from the other side
            value[:, s] = 0
            sums = value.sum(axis=0)
            self.pairs[s] = self.pairs[s] + sums if s in self.pairs else sums
            more = rows[mine > overall[rows]]
            values = distance(p[more, s], overall[more])
            order = np.lexsort((more, -values))[: self.top]  # terms come in order, so places decide ties
            found = [(-int(values[k]), self.terms[more[k]]) for k in order]
            self.best[s] = list(heapq.merge(self.best[s], found))[: self.top]
        self.terms, self.at = [], []

    def sums(self) -> Iterator[pa.RecordBatch]:
        for s, values in self.pairs.items():
            at = np.flatnonzero(values)
            if len(at):
                mine = self.names[s]
                others = [self.names[k] for k in at]
                yield self.batch(0, [min(mine, o) for o in others], [max(mine, o) for o in others], values[at].tolist())
        self.pairs = {}

    def batch(self, kind: int, a: list[str], b: list[str], values: list[int]) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * n, pa.string()), pa.array([kind] * n, pa.int32()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(values, pa.int64())], names=["lang", "kind", "a", "b", "value"])

    def end(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        yield from self.sums()
        for s, found in self.best.items():
            if found:
                yield self.batch(1, [self.names[s]] * len(found), [t for _, t in found], [-v for v, _ in found])


def _compare(top: int):
    """Streams a range's terms, in order, after the sums of their language's sources."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, started = None, None, False
        for batch in batches:
            for part, lang, kind, item, n, v, sources, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "kind", "item", "n", "v", "sources", "counts")), strict=True):
                if (part, lang) != key:
                    if now:
                        yield from now.end()
                    now, key, started = _Language(lang, top), (part, lang), False
                if kind == 0:
                    now.names.append(item)
                    now.total.append(n)
                    now.v = v
                    continue
                if not started:
                    now.begin()
                    started = True
                now.add(item, sources, counts)
                if now.full():
                    now.settle()
                    if len(now.pairs) * len(now.names) >= CELLS:
                        yield from now.sums()
        if now and started:
            yield from now.end()

    return compared


def audit_sources(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """For each (lang, source) group of `docs`: the other sources of the language by how far their words are apart (part `pair`),
    and the terms that tell the group from its language (part `term`, the first `top`): lang, source, part, item, value, rank.

    A language keeps the terms that `min_docs` of its rows have. A group's share of a kept term is
    p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N its count of all V kept terms, and p and q differ by
    floor((p - q)^2 / (p + q)); all of it in whole numbers. Ranks begin with 1, larger values first, then items by UTF-8.

    Defined cases: null langs, sources and texts count as ''; a group without terms still has shares; a language without kept
    terms has pairs of value 0; repeated rows count each; an empty table gives no rows; other columns are not read.

    Tasks count terms in byte tries with counters by source, so a hot source or word shrinks where it is read. The tries'
    leaves are dealt to ranges of (lang, term), merged there in order, and the kept ones go on with the sums of
    their language's groups sent to each range that needs them; nothing is collected or broadcast. A range streams its
    terms and gives out a sum for each pair of sources (only of terms that one of them has; what all others add is one
    product) and `top` candidates a group. Work and rows by pairs of sources are those of the result.
    """
    ws = Workspace(docs.sparkSession, "divergence")
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    tries = ws.stage(given.mapInArrow(_gather, LEAF), "tries")
    ranges = tries.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    kept = ws.stage(ranges.mapInArrow(_merge(min_docs), LEAF).select("lang", "term", "sources", "counts", F.spark_partition_id().alias("part")), "kept")

    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    sums = each.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = given.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left")
    groups = ws.stage(groups.select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("v", F.lit(0)).cast("long").alias("v")), "groups")

    none = lambda kind: F.lit(None).cast(kind)
    ahead = kept.select("part", "lang").distinct().join(groups, "lang")
    ahead = ahead.select("part", "lang", F.lit(0).alias("kind"), F.col("source").alias("item"), "n", "v", none("array<string>").alias("sources"), none("array<long>").alias("counts"))
    stream = ahead.unionByName(kept.select("part", "lang", F.lit(1).alias("kind"), F.col("term").alias("item"), none("long").alias("n"), none("long").alias("v"), "sources", "counts"))
    found = ws.stage(stream.repartition("part", "lang").sortWithinPartitions("part", "lang", "kind", "item").mapInArrow(_compare(top), FOUND), "found")

    share = F.expr("1 + 2000000000L div greatest(n + 2 * v, 1)")
    one = groups.select("lang", F.col("source").alias("a"), "v", share.alias("p"))
    two = groups.select("lang", F.col("source").alias("b"), share.alias("q"))
    far = found.where("kind = 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    # each unordered pair once; its two rows differ in the names only
    pairs = one.join(two, "lang").where("a < b").join(far, ["lang", "a", "b"], "left")
    value = F.expr("v * ((p - q) * (p - q) div (p + q)) + coalesce(more, 0)")
    pairs = pairs.select("lang", value.alias("value"), F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    shape = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank")]
    leading = found.where("kind = 1").select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").select(*shape("term")).where(F.col("rank") <= top)
    return pairs.select("lang", "x.source", "x.item", "value").select(*shape("pair")).unionByName(leading)
