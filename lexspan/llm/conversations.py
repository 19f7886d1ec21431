"""Repair of conversations whose turns don't alternate: A* over the lattice of rows and grammar states."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Workspace, join_unique

#: Rows and characters of one lattice. Longer conversations are cut into segments, and every way through each is worked out.
SEGMENT_ROWS, SEGMENT_CHARS = 512, 4_000_000
#: Short lattices whose cheapest edits a worker remembers.
MEMO_ROWS = 24
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a. What follows a state on a symbol, and the one of u and a that may.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_OPEN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}

SEGMENT = (
    "conv_id {id}, whole boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, "
    "cost long, audit string, sha string, ways array<struct<entry int, exit int, cost long, audit string>>, lines array<struct<role string, text string>>"
)
TOTALS = "blank long, duplicate long, truncated long, illegal long, gaps long, cost long"


def search(codes: str, entry: int, wanted: frozenset[int]) -> dict[int, tuple[int, str]]:
    """Cheapest edits of a run of rows that lead from state `entry` to each of the states: state -> (cost, edits' initials).

    A row's code is its role's initial (x: another than s, u and a), upper case where it is truncated, or ! where it must
    go. A node is (rows done, state). The heuristic is the sum over the rows left of what each costs in any case: 4 if it
    must go, 3 if it is truncated (kept for 3 or deleted for 4). No edit costs less than it lowers the heuristic,
    so nodes leave the heap in order of (cost plus heuristic, edits), and the first to come out for a node is its cheapest,
    ASCII-least one. Ends once one of `wanted` is reached after the last row; if that is empty, once all states are known.
    """
    n = len(codes)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if codes[i] == "!" else TRUNCATED if codes[i].isupper() else 0)
    heap, done, found = [(rest[0], "", 0, entry)], set(), {}
    while heap:
        bound, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            found[state] = (bound, audit)
            if state in wanted:
                break
        after = _OPEN[state]
        heapq.heappush(heap, (bound + INSERT, audit + "I", i, after))
        if i == n:
            continue
        code, saved = codes[i], rest[i] - rest[i + 1]
        heapq.heappush(heap, (bound + DELETE - saved, audit + "D", i + 1, state))
        if code == "!":
            continue
        extra = (TRUNCATED if code.isupper() else 0) - saved
        if (kept := _NEXT.get((state, code.lower()))) is not None:
            heapq.heappush(heap, (bound + KEEP + extra, audit + "K", i + 1, kept))
        heapq.heappush(heap, (bound + REROLE + extra, audit + "R", i + 1, after))
    return found


def whole(codes: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    found = search(codes, START, frozenset((START, ASSISTANT)))
    return min(found[s] for s in (START, ASSISTANT) if s in found)


_short = lru_cache(100_000)(whole)


def repaired(lines: list[tuple[str, str]], audit: str, state: int) -> Iterator[str]:
    """The lines of a run after its edits, from `state` on."""
    rows = iter(lines)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        after = _NEXT[state, role[:1]] if edit == "K" else _OPEN[state]
        yield f"{role if edit == 'K' else _ROLE[after]}:{text}"
        state = after


class Segment:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.lines, self.chars = conv_id, [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if self.codes:
            self.illegal += self.last + initial not in _LEGAL
        else:
            self.first = initial
        self.last = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        code = initial if initial in ("s", "u", "a") else "x"
        self.codes.append("!" if fault in ("b", "d") else code.upper() if fault == "t" else code)
        self.lines.append((role, text))
        self.chars += len(role) + len(text)

    def row(self, alone: bool) -> dict:
        codes = "".join(self.codes)
        out = {k: getattr(self, k) for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")} | {"whole": alone}
        if alone:
            cost, audit = (_short if len(codes) <= MEMO_ROWS else whole)(codes)
            return out | {"cost": cost, "audit": audit, "sha": hashlib.sha256("\n".join(repaired(self.lines, audit, START)).encode()).hexdigest()}
        ways = [{"entry": entry, "exit": state, "cost": cost, "audit": audit} for entry in range(4) for state, (cost, audit) in search(codes, entry, frozenset()).items()]
        return out | {"ways": ways, "lines": [{"role": r, "text": t} for r, t in self.lines]}


def _weight(row: dict) -> int:
    """A row counts for one and for each 32,768 characters of text that it has."""
    return 1 + (sum(len(x["text"]) for x in row.get("lines") or ()) + len(row.get("kept") or "")) // 32_768


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += _weight(row)
        if weight >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cut(schema: pa.Schema, most_rows: int) -> Callable:
    """Segments of a partition's rows, which are in order; a conversation that lies between two others is whole."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, before, runs = None, None, 0
        # `before`: the segment before this one of the same conversation has been given out, so this one isn't whole
        for batch in batches:
            for conv, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")), strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        # the partition's first conversation may have begun in another one
                        yield now.row(alone=not before and runs > 1)
                    now, before, runs = Segment(conv), False, runs + 1
                elif len(now.codes) >= most_rows or now.chars >= SEGMENT_CHARS:
                    yield now.row(alone=False)
                    now, before = Segment(conv), True
                now.add(turn, role, text, fault)
        if now is not None:
            yield now.row(alone=False)

    return lambda batches: _batches(rows(batches), schema)


class _Way:
    """The cheapest way to a state after some segments: a chain of their edits, newest first."""

    __slots__ = ("cost", "edits", "entry", "past", "pos")

    def __init__(self, past: _Way | None, cost: int, edits: str, entry: int, pos: int):
        self.past, self.cost, self.edits, self.entry, self.pos = past, cost, edits, entry, pos

    def chain(self) -> list[_Way]:
        found, way = [], self
        while way.past is not None:
            found.append(way)
            way = way.past
        return found[::-1]


def _less(a: _Way, b: _Way) -> bool:
    """Whether the way a is to be taken before b, which has as many segments: by cost, then by the edits since they parted."""
    if a.cost != b.cost:
        return a.cost < b.cost
    one, two = [], []
    while a is not b:
        one.append(a.edits)
        two.append(b.edits)
        a, b = a.past, b.past
    return "".join(one[::-1]) < "".join(two[::-1])


def _fold(schema: pa.Schema) -> Callable:
    """Cheapest edits over all segments of each conversation: a row for each segment (pos), then one with the totals (pos null)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ways: dict[int, _Way] = {}
        total: dict = {}

        def close() -> Iterator[dict]:
            best = None
            for state in (START, ASSISTANT):
                if state in ways and (best is None or _less(ways[state], best)):
                    best = ways[state]
            # (a segment's ways include insertions after its last row)
            chain = best.chain()
            for way in chain:
                yield {"conv_id": total["conv_id"], "pos": way.pos, "entry": way.entry, "audit": way.edits}
            gaps = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["turns"]
            yield {k: total[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": best.cost, "audit": "".join(w.edits for w in chain)}

        for batch in batches:
            for seg in batch.to_pylist():
                if total and seg["conv_id"] == total["conv_id"]:
                    for k in ("blank", "duplicate", "truncated", "illegal"):
                        total[k] += seg[k]
                    total["illegal"] += total["last"] + seg["first"] not in _LEGAL
                    total["last"] = seg["last"]
                    if seg["low"] is not None:
                        total["turns"] += seg["turns"] - (seg["low"] == total["high"])
                        total["low"], total["high"] = seg["low"] if total["low"] is None else total["low"], seg["high"]
                else:
                    if total:
                        yield from close()
                    total, ways = dict(seg), {START: _Way(None, 0, "", START, -1)}
                found: dict[int, _Way] = {}
                for w in seg["ways"]:
                    if (past := ways.get(w["entry"])) is not None:
                        way = _Way(past, past.cost + w["cost"], w["audit"], w["entry"], seg["pos"])
                        if w["exit"] not in found or _less(way, found[w["exit"]]):
                            found[w["exit"]] = way
                ways = found
        if total:
            yield from close()

    return lambda batches: _batches(rows(batches), schema)


def _texts(schema: pa.Schema) -> Callable:
    """The repaired text of each segment; null where nothing is left of it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for conv, pos, entry, audit, lines in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "entry", "audit", "lines")), strict=True):
                kept = list(repaired([(x["role"], x["text"]) for x in lines], audit, entry))
                yield {"conv_id": conv, "pos": pos, "kept": "\n".join(kept) if kept else None}

    return lambda batches: _batches(rows(batches), schema)


def _hashes(schema: pa.Schema) -> Callable:
    """SHA-256 over the texts of each conversation's segments, which come in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, sha, any_yet = None, None, False
        for batch in batches:
            for c, kept in zip(batch.column("conv_id").to_pylist(), batch.column("kept").to_pylist(), strict=True):
                if sha is None or c != conv:
                    if sha is not None:
                        yield {"conv_id": conv, "sha": sha.hexdigest()}
                    conv, sha, any_yet = c, hashlib.sha256(), False
                if kept is not None:
                    sha.update(b"\n" * any_yet + kept.encode())
                    any_yet = True
        if sha is not None:
            yield {"conv_id": conv, "sha": sha.hexdigest()}

    return lambda batches: _batches(rows(batches), schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes
    its . ! and ?, 3 repeats it, 4 makes its role user. Nulls count as one space there, and null roles and texts become one."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), given("role").alias("role"), given("text").alias("text"), hit.alias("__hit")).where("__hit != 0")
    text = F.when(F.col("__hit") == 1, "").when(F.col("__hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__hit") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("__hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("__copy")).drop("__copy")


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The cheapest repair of every conversation of `rows` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit (the edits' initials) and repaired_sha256 (of the repaired `role:text` lines).

    Rows come by turn, null turns first; rows of one turn by role and text. A row's first fault counts: blank, duplicate (role
    and text seen earlier in the conversation), truncated (doesn't end in . ! or ?). Keeping a row costs 0, giving it the
    other role 3, deleting it 4 (blank and duplicate rows must go), an empty turn put in 3, a truncated row that stays 3 more.
    The edits are those of least cost, of these the ASCII-least, that give the initials (s?(ua)+)?.

    Defined cases: null roles and texts count as one space; a null conv_id is a conversation; a role that begins with
    another letter than s, u or a (or is empty) can only be deleted or changed; repeated rows are duplicates of the
    first; an empty table gives no rows; other columns are not read.

    Rows are range-sorted over all conversations, so one of any length lies in many partitions. Each partition cuts
    what it has into segments of `segment_rows` rows at most. A* solves a conversation that is one segment; for the segments
    of others, also those at a partition's ends, it finds the cheapest edits from each grammar state to each, and a fold
    over these small tables picks the ways. Texts of segments are repaired where they are; only their SHA-256, which no
    two tasks can share, reads a conversation's text in one task, as a stream. Earlier equal rows are found by a
    partially aggregated minimum of places over digests, joined by broadcast where a digest is hot.
    """
    ws = Workspace(rows.sparkSession, "conversations")
    text = F.btrim("text", F.lit(WHITE))
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    given = given.withColumn("fault", F.when(text == "", "b").when(F.right(text, F.lit(1)).isin(".", "!", "?"), "").otherwise("t"))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    one = F.concat(F.length(conv).cast("string"), F.lit(":"), conv, F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    given = ws.stage(given.select("*", F.unhex(F.sha2(one, 256)).alias("digest"), F.monotonically_increasing_id().alias("id")), "rows")

    place = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"), F.col("id").alias("c"))
    seen = given.where("fault != 'b'").groupBy("digest").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = join_unique(given, ws.stage(seen, "seen"), ["digest"], "n")
    fault = F.when((F.col("fault") != "b") & (place > F.col("earliest")), "d").otherwise(F.col("fault"))
    order = ["conv_id", "turn", "role", "text", "id"]
    sorted_rows = marked.select(*order, fault.alias("fault")).repartitionByRange(*order).sortWithinPartitions(*order)

    kind = given.schema["conv_id"].dataType.simpleString()
    arrow = lambda ddl: _arrow(rows, ddl)
    schema = SEGMENT.format(id=kind)
    cut = sorted_rows.select("conv_id", "turn", "role", "text", "fault").mapInArrow(_cut(arrow(schema), segment_rows), schema)
    segments = ws.stage(cut.withColumn("pos", F.monotonically_increasing_id()), "segments")

    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    alone = segments.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))

    parts = segments.where("not whole")
    schema = f"conv_id {kind}, pos long, entry int, audit string, {TOTALS}"
    narrow = parts.select("conv_id", "pos", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "ways")
    plan = ws.stage(narrow.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_fold(arrow(schema)), schema), "plan")
    schema = f"conv_id {kind}, pos long, kept string"
    chosen = plan.where("pos is not null").select("conv_id", "pos", "entry", "audit").join(parts.select("pos", "lines"), "pos")
    texts = chosen.select("conv_id", "pos", "entry", "audit", "lines").mapInArrow(_texts(arrow(schema)), schema)
    schema = f"conv_id {kind}, sha string"
    hashed = texts.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_hashes(arrow(schema)), schema)
    totals, hashed = plan.where("pos is null").alias("t"), hashed.alias("h")
    cut_up = totals.join(hashed, F.col("t.conv_id").eqNullSafe(F.col("h.conv_id"))).select("t.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
    return alone.unionByName(cut_up)


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def repair_damaged(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """repair() of the damaged() rows, with a row for every conversation that there was: one that lost all rows has zeros, no edits
    and the hash of an empty text."""
    found = repair(damaged(conversations), segment_rows).alias("f")
    all_of_them = conversations.select("conv_id").distinct().alias("c")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_of_them.join(found, F.col("c.conv_id").eqNullSafe(F.col("f.conv_id")), "left").select(
        "c.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
