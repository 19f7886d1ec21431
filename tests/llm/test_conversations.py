import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from lexspan.llm.conversations import ASSISTANT, START, damaged, repair, repair_damaged, search, whole
from lexspan.llm.queries import op12_conversation_repair

WHITE = " \t\n\x0b\f\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def every_way(rows):
    """Cost, edits and repaired lines of all edit sequences of a few rows [(role, text, fault)], with at most two insertions in a place."""

    def go(i, cost, audit, lines, inserted):
        if i == len(rows):
            yield cost, audit, lines
        if inserted < 2:
            for role in ("user", "assistant"):
                yield from go(i, cost + 3, audit + "I", [*lines, f"{role}:"], inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            yield from go(i + 1, cost + 4, audit + "D", lines, 0)
            if fault not in ("b", "d"):
                extra = 3 * (fault == "t")
                yield from go(i + 1, cost + extra, audit + "K", [*lines, f"{role}:{text}"], 0)
                for other in ("user", "assistant"):
                    yield from go(i + 1, cost + 3 + extra, audit + "R", [*lines, f"{other}:{text}"], 0)

    good = re.compile("(s?(ua)+)?")
    return min((x for x in go(0, 0, "", [], 0) if good.fullmatch("".join(line[:1] if line[0] != ":" else "?" for line in x[2]))), key=lambda x: x[:2])


def by_table(rows):
    """The same for any number of rows, by a plain table over rows and states."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def put(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                for new in step[state].keys() & names.keys():
                    put(table, new, (cost + 3, audit + "I", [*lines, f"{names[new]}:"]))
        return table

    table = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, lines) in table.items():
            put(after, state, (cost + 4, audit + "D", lines))
            if fault not in ("b", "d"):
                extra = 3 * (fault == "t")
                if role[:1] in step[state]:
                    put(after, role[:1], (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
                for new in step[state].keys() & names.keys():
                    put(after, new, (cost + 3 + extra, audit + "R", [*lines, f"{names[new]}:{text}"]))
        table = inserted(after)
    return min((table[s] for s in ("", "a") if s in table), key=lambda x: x[:2])


def with_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        out.append((role, text, "b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t"))
        seen.add((role, text))
    return out


def expected(conv_id, rows):
    """The contract's row for rows (turn, role, text) in order."""
    faults = with_faults([r[1:] for r in rows])
    turns = [r[0] for r in rows if r[0] is not None]
    cost, audit, lines = by_table(faults)
    count = lambda f: sum(x[2] == f for x in faults)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv_id, gaps, count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(rows):
    """Rows (conv_id, turn, role, text) after the damage, each with its place, in order."""
    out = []
    blank = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        hit, role, text = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20, blank(role), blank(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3]))


def wanted(rows, damage=True):
    rows_now = plain_damage(rows) if damage else sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3]))
    found = {c: expected(c, [r[1:] for r in g]) for c, g in groupby(rows_now, key=lambda r: r[0])}
    return sorted((found.get(c) or expected(c, []) for c in {r[0] for r in rows}), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def table(spark, rows, partitions=3):
    full = [(*r, "en", 3) for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn int, role string, text string, fault string, id int").repartition(partitions)


def some_rows(rng, conv, n, turns=None):
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", "One. Two", "ok. ", "Ünï."]
    return [(conv, rng.choice(turns) if turns else i, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Student"]), rng.choice(texts) + rng.choice(["", "", f"{i}."])) for i in range(n)]


def test_search_finds_the_least_of_all_ways():
    rng = random.Random(4)
    for _ in range(250):
        rows = with_faults([r[2:] for r in some_rows(rng, 1, rng.randrange(0, 4))])
        codes = "".join("!" if f in ("b", "d") else (c := r[:1] if r[:1] in ("s", "u", "a") else "x").upper() if f == "t" else (r[:1] if r[:1] in ("s", "u", "a") else "x") for r, _, f in rows)
        assert whole(codes) == every_way(rows)[:2] == by_table(rows)[:2]


def test_search_equals_a_table_on_long_runs():
    rng = random.Random(5)
    for n in (10, 60, 400):
        rows = with_faults([r[2:] for r in some_rows(rng, 1, n)])
        codes = "".join("!" if f in ("b", "d") else (r[:1] if r[:1] in ("s", "u", "a") else "x").upper() if f == "t" else (r[:1] if r[:1] in ("s", "u", "a") else "x") for r, _, f in rows)
        assert whole(codes) == by_table(rows)[:2]
        found = search(codes, START, frozenset())
        assert min(found[START], found[ASSISTANT]) == whole(codes)


def test_search_looks_at_few_nodes_where_little_is_wrong():
    assert whole("s" + "ua" * 200) == (0, "K" * 401) and whole("SUA" + "ua" * 9) == (9, "K" * 21)


@pytest.mark.parametrize("segment_rows", [1, 3, 512])
def test_segments_give_what_whole_conversations_give(spark, segment_rows):
    rng = random.Random(6)
    rows = [r for c in range(40) for r in some_rows(rng, c, rng.randrange(1, 30))] + some_rows(rng, 99, 300)
    assert got(repair(table(spark, rows).drop("fault", "id"), segment_rows)) == wanted(rows, damage=False)


def test_odd_rows(spark):
    """Nulls in every column, ties of turns, repeated rows, clashing names, a very long text, conversations that vanish."""
    rng = random.Random(7)
    rows = [r for c in range(60) for r in some_rows(rng, c, rng.randrange(1, 9), turns=[None, 1, 1, 2, 5, -3, 2_000_000_000])]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hi."), (7, 3, None, "Text."), (7, 4, "user", None), (8, None, None, None), *[(70, 2, "user", "Same.")] * 5, (71, 1, "user", "long " * 300_000 + "."), (72, None, "user", "A."), (72, None, "assistant", "B.")]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows.append((gone, 1, "user", "Gone."))
    found = got(repair_damaged(table(spark, rows), 4))
    assert found == wanted(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found
    assert repair_damaged(table(spark, rows).where("turn = 77")).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(30) for t in range(6)]
    assert sorted((tuple(r) for r in damaged(table(spark, rows)).collect())) == sorted(plain_damage(rows))


def test_one_conversation_of_many_rows(spark):
    """A third of all rows in one conversation, the same line again and again: no task has them all."""
    rng = random.Random(8)
    rows = [r for c in range(800) for r in some_rows(rng, c, 5)] + [(9999, t, ("user", "assistant")[t % 2], "Same." if t % 3 else f"Line {t}.") for t in range(2000)]
    df = table(spark, rows, 8)
    assert got(repair(df, 64)) == wanted(rows, damage=False)


def test_query_equals_the_table(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    df = op12_conversation_repair(spark, sf_dir)
    assert df.columns == COLUMNS and [t for _, t in df.dtypes[1:]] == ["bigint"] * 6 + ["string"] * 2
    assert got(df) == wanted(rows)
