import random

import numpy as np
import xxhash

from lexspan.llm.common import LAST_ID, Workspace
from lexspan.llm.queries import op6_simhash
from lexspan.llm.simhash import close_groups, components, fingerprint, keep_one, links, near_groups


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\f\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), 42).intdigest()
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def slow_components(fps):
    """fps: (id, unsigned fingerprint) -> id -> smallest reachable id."""
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(fps):
        for j, y in fps[:a]:
            if (x ^ y).bit_count() <= 3:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i, _ in fps}


def test_fingerprint():
    for text in [None, "", " \n", "one", "One TWO", "A b c", "a b c d e f g " * 30, "É é straße İx y z w", "w x y z"]:
        assert fingerprint(text) & (2**64 - 1) == slow_fingerprint(text), text


def planted(rng, n, clusters, size):
    fps = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(clusters):
        x = rng.getrandbits(64)
        for _ in range(size):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4)))
            fps.append(x)
    return list(set(fps))


def test_bit_sliced_groups_equal_brute_force():
    rng = random.Random(1)
    group, fp, want = [], [], []
    for g, (n, size) in enumerate([(1, 0), (3, 2), (100, 40), (70, 3), (200, 200), (1, 1)]):
        own = planted(rng, n, 1, size)
        root = slow_components(list(enumerate(own)))
        want += [root[i] + len(group) for i in range(len(own))]
        group += [g] * len(own)
        fp += own
    assert close_groups(np.array(group), np.array(fp, np.uint64)).tolist() == want


def test_links_and_components(spark):
    rng = random.Random(2)
    fps = [(i, x) for i, x in enumerate(planted(rng, 300, 6, 60))]
    signed = [(x - (1 << 64) if x >> 63 else x,) for _, x in fps]
    ws = Workspace(spark, "test")
    prints = ws.stage(spark.createDataFrame(signed, "fp long"), "prints")
    by_value = slow_components([(s[0], x) for s, (_, x) in zip(signed, fps, strict=True)])
    for part in (4096, 16):  # 16: buckets are compared in pairs of parts
        got = {r.node: r.root for r in components(ws, links(Workspace(spark, "test"), prints, part)).collect()}
        assert got == {k: v for k, v in by_value.items() if k in got}
        assert set(got) == {k for k in by_value if sum(v == by_value[k] for v in by_value.values()) > 1 and by_value[k] != k}
        ws = Workspace(spark, "test")


def test_chain_of_components(spark):
    n = 200
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1001, 1000)], "u long, v long")
    got = {r.node: r.root for r in components(Workspace(spark, "test"), edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_op6_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = slow_components(sorted(rows))
    got = op6_simhash(spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{x:016x}", want[i]) for i, x in rows} and len(got) == len(rows)


def test_odd_rows(docs, odd_rows):
    got = near_groups(docs(odd_rows)).collect()
    want = slow_components(sorted({(LAST_ID if i is None else i, slow_fingerprint(t)) for i, t in odd_rows if i not in (4, None)} | {(4, slow_fingerprint(odd_rows[3][1]))}))
    assert len(got) == len(odd_rows)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert {r.component_id for r in got if r.doc_id is None} == {1, 4}
    kept = sorted(r.doc_id for r in keep_one(docs(odd_rows)).collect())
    assert kept == sorted(i for i, _ in odd_rows if i is not None and want[i] == i)
    assert near_groups(docs([])).count() == 0
    shared = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (2, "quite another text here"), (None, "alpha beta gamma delta"), (None, "and one without an id")]
    assert sorted((r.doc_id or 0, r.text) for r in keep_one(docs(shared)).collect()) == [(0, shared[4][1]), (1, shared[0][1]), (2, shared[2][1])]


def test_keep_one_with_clashing_columns(spark):
    names = "__gone long, __text string, gone_id long, gone_hash long, text_hash long, fp long, component_id long, row int"
    rows = [(i, "one two three four five six", "s", *[i, "t", *range(6)]) for i in (4, 2, 3)] + [(None, None, None, *[0, "t", *range(6)])]
    table = spark.createDataFrame(rows, f"doc_id long, text string, source string, {names}")
    kept = keep_one(table)
    assert kept.columns == table.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2]
