import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyarrow.dataset import dataset

from lexspan.llm import divergence
from lexspan.llm.divergence import Trie, audit_sources, shares, terms
from lexspan.llm.oracles import ORACLES
from lexspan.llm.queries import op11_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def expected(rows, least=10, top=10):
    """The contract on rows (lang, source, text), term by term and pair by pair."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, df, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, text in rows:
        found = TERM.findall(text.translate(LOWER))
        counts[lang, source].update(found)
        df[lang].update(set(found))
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in df[lang].items() if n >= least]
        mine = {s: c for (x, s), c in counts.items() if x == lang}
        together = sum(mine.values(), Counter())

        def share(c):
            whole = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // whole for t in kept}

        p, q = {s: share(c) for s, c in mine.items()}, share(together)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in mine if o != s))
            best = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if mine[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", best)) for k, (v, item) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(k, *r, "x", 1) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, part int").repartition(partitions)


WORDS = [*"abcdefgh", "Alpha", "alpha", "beta", "betamax", "Été", "été", "中文", "naïve", "x\x7fy", "don't", "U\u0085V", " ", "[z]", "éA", "a1b", "😀"]


def some_rows(rng, n, langs=("en", "de", None), sources=("s1", "s2", "é", "", None, "😀", "z")):
    return [(rng.choice(langs), rng.choice(sources), rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(40)))])) for _ in range(n)]


def test_terms_equal_the_pattern():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(0, 0x180), rng.randrange(0x20, 0x7F), rng.randrange(0xE000, 0x110000)])) for _ in range(20))
        assert [t.decode() for t in terms(text.encode())] == TERM.findall(text.translate(LOWER))


def test_trie_keeps_order_and_merges():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé中") for _ in range(rng.randrange(1, 7))).encode() for _ in range(2000)]
    parts, want = [Trie(), Trie()], Counter()
    for k, w in enumerate(words):
        parts[k % 2].add(w, 1, {f"s{k % 3}": 2})
        want[w] += 2
    parts[0].merge(parts[1])
    found = [(t, n.df, sum(n.counts.values())) for t, n in parts[0].walk()]
    assert [t for t, _, _ in found] == sorted(want, key=lambda b: b.decode()) and parts[0].leaves == len(want)
    assert all(total == want[t] == 2 * df for t, df, total in found)


def test_shares_are_exact():
    rng = random.Random(3)
    whole = [rng.randrange(2, 9 * 10**15) for _ in range(1000)]
    counts = [rng.randrange(1, w + 1) for w in whole]
    assert shares(np.array(counts), np.array(whole)).tolist() == [1 + 10**9 * c // w for c, w in zip(counts, whole, strict=True)]


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_small_tables(spark, monkeypatch, seed, small):
    """Nulls, empty texts, ties (many terms with equal counts), groups without terms, clashing names."""
    rows = some_rows(random.Random(seed), 400)
    if small:  # tries are written out, and cells settled, again and again
        for name, value in (("GATHERED", 10), ("LEAVES", 5), ("CELLS", 20)):
            monkeypatch.setattr(divergence, name, value)
    rows += [("fr", "only", "rare words"), ("it", "s1", None), ("it", "s2", "qui")]
    found = got(audit_sources(table(spark, rows)))
    assert found == expected(rows)
    assert ("it", "s1", "pair", "s2", 0, 1) in found and not any(r[0] == "fr" for r in found)


def test_other_parameters_and_an_empty_table(spark):
    rows = some_rows(random.Random(5), 60, ("en",), ("a", "b", "c"))
    assert got(audit_sources(table(spark, rows), min_docs=1, top=3)) == expected(rows, 1, 3)
    assert audit_sources(table(spark, rows).where("doc_id < 0")).collect() == []


def test_a_hot_source_and_repeated_rows(spark):
    rng = random.Random(6)
    rows = some_rows(rng, 300, ("en",)) + [("en", "hot", "alpha beta alpha")] * 500 + [("en", "hot", "long " * 100_000)]
    assert got(audit_sources(table(spark, rows, 6))) == expected(rows)


def test_query_equals_its_sql_and_the_plain_version(spark, sf_dir):
    df = op11_divergence(spark, sf_dir)
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    found = got(df)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text").collect()
    assert found == expected([tuple(r) for r in docs])
    con = duckdb.connect()
    con.register("documents", dataset(f"{sf_dir}/documents.parquet").to_table())
    assert sorted(con.execute(ORACLES["op11_divergence"]).fetchall()) == found
