"""Literal expectations for operators that the registered queries don't pin down."""

import random

import pytest
from pyspark.sql import functions as F

from lexspan import plans
from lexspan.operators import changes, logs, registry, resolve, search, tree
from lexspan.plans import searches
from lexspan.schema import TABLES, empty
from lexspan.snapshots import Conflict, Snapshots
from lexspan.staging import Workspace


def test_every_table_has_a_schema(spark):
    assert all(empty(spark, t).count() == 0 for t in TABLES)


def test_phrase_search(spark):
    rows = spark.createDataFrame([(1, "No parking allowed on Main Street between 8am and 6pm.", "Section 1"), (2, "Residential zoning permits single-family homes only.", "Section 2"), (3, "All dogs must be leashed in public parks.", "Section 3"), (4, "See 5.10.010 and short term rental rules", "§ 4")], "id int, text string, heading string")
    found = lambda q: [r.id for r in search.search(rows, q, ["text", "heading"], 100, F.col("id")).collect()]
    assert found("parking") == [1] and found("nonsense") == [] and found("") == [] and found("section") == [1, 2, 3]
    assert found("short-term") == [4] and found("5.10") == [4] and found("park") == [] and found("zoning section") == [2] and found("§") == []
    assert search.search(rows, "section", ["heading"], 1, F.col("id")).count() == 1 and search.search(rows, "section", ["heading"], -1, F.col("id")).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    snip = spark.range(1).select(search.snippet(F.lit(text), F.lit("w30")).alias("s"), search.snippet(F.lit(text), F.lit("absent")).alias("t")).first()
    assert snip.s == "..." + " ".join(f"w{i}" for i in range(30, 50)) + "..." and snip.t == " ".join(f"w{i}" for i in range(20)) + "..."
    cases = [("First. Second Sentence here!", "second", "...Second Sentence here!"), ("«Café» au lait.", "CAFE", "«Café» au lait."), ("Cafe\u0301, b", "café b", "Cafe\u0301, b"), ("(a) b-c d", "b c", "...b-c d"), ("", "x", ""), (None, "x", None)]
    for text, phrase, want in cases:
        assert spark.range(1).select(search.snippet(F.lit(text).cast("string"), F.lit(phrase)).alias("s")).first().s == want, text


def test_accents_and_case_do_not_matter(spark):
    texts = ["Un CAFÉ noir", "un cafe\u0301 noir", "un cafe noir", "Ünïted", "ÅNGSTRÖM", "naïveté"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = lambda q: {r.id for r in rows.where(search.matches(q, "text")).collect()}
    assert found("cafe") == found("CAFÉ") == found("cafe\u0301") == {0, 1, 2} and found("united") == {3} and found("ångstrom") == {4} and found("naivete") == {5}


def test_phrase_index_stays_in_step(spark, tmp_path):
    """The index finds what the predicate finds, after a build, a refresh with changed and deleted rows, and compaction."""
    have = "id int, text string, head string"
    one = [(1, "No parking on Main Street", "Section 1"), (2, "The parking-lot on Côté street", None), (3, None, "parking main"), (4, "lot parking", ""), (5, "street main street on main", "x")]
    queries = ["parking", "parking main", "parking-lot", "main-street", "COTE", "on main", "section", "§", "", "  ", "lot-parking absent", "street street"]
    columns = ["text", "head"]

    def agree(index, rows):
        table = spark.createDataFrame(rows, have)
        for q in queries:
            assert {r.key for r in index.find(q).collect()} == {r.id for r in table.where(search.matches(q, *columns)).collect()}, q
        asked = spark.createDataFrame(list(enumerate(queries)), "query int, text string")
        got = {tuple(r) for r in index.find_each(asked, table, "id", columns).collect()}
        assert got == {(i, r.id) for i, q in enumerate(queries) for r in table.where(search.matches(q, *columns)).collect()}

    index = search.PhraseIndex(spark, f"file://{tmp_path}/a").build(spark.createDataFrame(one, have), "id", columns)
    agree(index, one)
    changed = [(2, "section main street", None), (6, "new parking", "côte")]
    index.refresh(spark.createDataFrame(changed, have), spark.createDataFrame([(4,)], "id int"), "id", columns)
    now = [r for r in one if r[0] not in (2, 4)] + changed
    agree(index, now)
    agree(index.compact(f"file://{tmp_path}/b"), now)


def test_delete_scope_counts(spark, sf_dir):
    """Deleted rows are counted, and a source that goes as a whole has a row."""
    old = spark.createDataFrame([("a", "en"), ("a", "de"), ("a", None), ("b", "en"), ("b", "en"), (None, "en")], "source string, lang string")
    count = lambda **scope: {tuple(r) for r in changes.delete_scope_counts(old, "source", **scope).collect()}
    assert count(source="a", lang="en") == {("a", 2, 1), ("b", 2, 0), (None, 1, 0)} and count(source="b", lang=None) == {("a", 3, 0), ("b", 0, 2), (None, 1, 0)}
    got = plans.QUERIES["delete_scope"](spark, sf_dir).agg(F.sum("dropped"), F.sum(F.col("kept") + F.col("dropped"))).first()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got[0] == docs.where("source = 'src1' and lang = 'en'").count() > 0 and got[1] == docs.count()


def test_match_catalog(spark):
    """Key, whole name, token sets; the same ending alone is no match, nor is another block's name."""
    have = "id long, block string, name string"
    left = spark.createDataFrame([(1, "a", "x"), (2, "a", "palm city"), (3, "a", "one two three four five six seven"), (4, "a", "oak city"), (5, "b", "palm city"), (6, "a", ""), (7, "a", None), (8, None, "palm city")], have)
    right = spark.createDataFrame([(1, "b", "y"), (20, "a", "palm city"), (19, "a", "palm city"), (30, "a", "seven six five four three two one"), (40, "a", "elm city"), (41, "a", ""), (42, None, "palm city")], have)
    want = {(1, "1", "key"), (2, "19", "name"), (3, "30", "fuzzy")} | {(i, None, "unmatched") for i in (4, 5, 6, 7, 8)}
    assert {tuple(r) for r in registry.match_catalog(left, right, "id", "block", "name").collect()} == want


def test_equal_names_do_not_pair_all_rows(spark):
    """One name on many rows of both sides: the best right row is taken before the join."""
    left = spark.range(300).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("block"), F.lit("palm city").alias("name"))
    right = spark.createDataFrame([(i, "a" if i % 2 else "c", "palm city", "town" if i == 5 else None) for i in range(200)] + [(900, "b", "palm city", "x"), (901, "b", "palm city", "town"), (902, "b", "palm city", "town"), (903, None, None, "town")], "ord int, block string, name string, kind string")
    found = registry.match_name(left, right, "block", "name", "key", "kind", ["town"], "ord")
    assert {(r.key, r.ord, r.kind) for r in found.collect()} == {(i, 5 if i % 3 == 0 else 901, "town") for i in range(300) if i % 3 < 2}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and plan.index("Join") < plan.index("Aggregate")


def test_domain_trust(spark):
    domains = spark.createDataFrame([(1, "lw.com"), (2, "kirkland.com"), (3, "justice.gov")], "id int, domain string")
    hosts = spark.createDataFrame([(h,) for h in ("lw.com", "blog.lw.com", "kirkland.com", "someagency.gov", "justice.gov", "random-blog.xyz", "notlw.com")], "host string")
    got = {r.host: (r.trusted_by, r.trusted) for r in resolve.trust(hosts, "host", domains, "domain", "id").collect()}
    assert got == {"lw.com": ("lw.com", True), "blog.lw.com": ("lw.com", True), "kirkland.com": ("kirkland.com", True), "someagency.gov": (None, True), "justice.gov": ("justice.gov", True), "random-blog.xyz": (None, False), "notlw.com": (None, False)}


def test_change_sets(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, n int")
    new = spark.createDataFrame([(2, "B", 20), (3, "C", 30)], "id int, name string, n int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(changes.upsert(old, new, ["id"])) == [(1, "a", 1), (2, "B", 20), (3, "C", 30)]
    assert rows(changes.upsert_columns(old, new, ["id"], ["n"])) == [(1, "a", 1), (2, "b", 20), (3, "C", 30)]
    assert rows(changes.insert_ignore(old, new, ["id"], F.col("n"))) == [(1, "a", 1), (2, "b", 2), (3, "C", 30)]
    assert rows(changes.delete_scope(old, id=1, name=None)) == [(2, "b", 2)]
    assert rows(changes.keep_last(old.unionByName(new), ["id"], F.col("n"))) == [(1, "a", 1), (2, "B", 20), (3, "C", 30)]
    notes = spark.createDataFrame([("section", "u", "p1", None), ("section", "u", "p2", None), ("caselaw", "u", None, 7), ("caselaw", "u", None, 8), ("section", "u", "p1", None)], "kind string, url string, path string, cluster int").withColumn("id", F.monotonically_increasing_id())
    had = notes.where("path = 'p2' or cluster = 7")
    got = changes.partial_unique(had, notes, {"section": ["url", "path"], "caselaw": ["url", "cluster"]}, "kind", F.col("id"))
    assert [r.accepted for r in got.orderBy("id").collect()] == [True, False, False, True, False]
    status = changes.change_status(spark.createDataFrame([(1, "pending", None, "x"), (2, "pending", 5, None)], "id int, status string, at int, triage_notes string"), F.when(F.col("id") == 1, "resolved"), F.lit(9), ("resolved",), "at", F.when(F.col("id") == 2, "note"))
    assert rows(status) == [(1, "resolved", 9, "x"), (2, "pending", 5, "note")]


def test_fuzzy_matching_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    words = [f"t{'x' * (i % 5)}{i}" for i in range(12)]
    base = [rng.sample(words, rng.randrange(1, 9)) for _ in range(40)]
    rows = [(i, "ab"[i % 2], rng.choice(base) + rng.sample(words, rng.randrange(0, 2))) for i in range(120)]
    table = spark.createDataFrame(rows, "id int, block string, tokens array<string>")
    score = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))

    def best(i, block, tokens, others):
        found = sorted((-score(tokens, t), j) for j, b, t in others if b == block and j != i and score(tokens, t) >= 0.85)
        return found and (i, found[0][1], round(-found[0][0], 9))

    got = {(r.id, r.match, round(r.score, 9)) for r in registry.match_fuzzy_self(table, "block", "tokens", "id").collect()}
    assert got == {x for r in rows if (x := best(*r, rows))}
    right = [(i + 1000, b, t) for i, b, t in rows[:50]]
    other = spark.createDataFrame(right, "rid int, block string, tokens array<string>")
    got = {(r.id, r.match, round(r.score, 9)) for r in registry.match_fuzzy(table, other, "block", "tokens", "id", "rid").collect()}
    assert got == {x for r in rows if (x := best(*r, right))}


def test_similar_sets_lose_no_pair_and_stage_few_candidates(spark):
    """Sets near the threshold, of other sizes too, among many that share a few rare tokens: as by brute force, and whole sets meet for few other pairs."""
    import random

    from lexspan.staging import Workspace

    rng = random.Random(5)
    rows = []
    for i in range(60):
        near = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 150))] + [f"own{i}-{j}" for j in range(8)]
        rows += [(10 * i + c, "a", sorted({t for t in near if rng.random() > c * 0.04} | {f"new{i}-{c}-{j}" for j in range(c)})) for c in range(5)]
    sets = {i: set(t) for i, _, t in rows}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    want = {(i, j) for i in sets for j in sets if i != j and jaccard(sets[i], sets[j]) >= 0.85}
    ws = Workspace(spark, "similar")
    members = ws.stage(registry._members(spark.createDataFrame(rows, "id long, block string, tokens array<string>"), "block", "tokens", "id"), "members")
    found = registry.similar_sets(ws, members, None, "block").collect()
    assert {(r.l_id, r.r_id) for r in found} == want and len(found) == len(want) > 100
    assert all(abs(r.score - jaccard(sets[r.l_id], sets[r.r_id])) < 1e-12 for r in found)
    assert spark.read.parquet(f"{ws.path}/candidates").count() < 3 * len(want)


def test_trees(spark):
    nodes = spark.createDataFrame([("c1", None, "chapter-1", 0, False), ("s1", "c1", "section-1", 0, True), ("s2", "c1", "section-2", 1, True), ("p", None, "part-preamble", 1, True), ("o", "gone", "orphan", 0, True)], "id string, parent string, slug string, ord int, has_content boolean")
    walk = [r.path for r in tree.preorder(tree.paths(nodes, 3), F.lit(1)).orderBy("sort_order").collect()]
    assert walk == ["chapter-1", "chapter-1/section-1", "chapter-1/section-2", "part-preamble"]
    assert {r.path for r in tree.paths(tree.reroot(nodes), 3).collect()} == {*walk, "orphan"}
    found = tree.paths(nodes, 3)
    assert {r.path for r in tree.subtree(found, "chapter-1").collect()} == set(walk[:3]) and tree.limit_depth(found, 1).count() == 2 and tree.limit_depth(found, 0).count() == 4


def test_deep_trees_and_cycles(spark):
    have = "id string, parent string, slug string, ord int"
    chain = [(f"n{i}", f"n{i - 1}" if i else None, f"s{i}", 0) for i in range(50)]
    got = tree.paths(spark.createDataFrame(chain, have)).collect()
    assert len(got) == 50 and {r.depth for r in got} == set(range(1, 51)) and max(got, key=lambda r: r.depth).path == "/".join(f"s{i}" for i in range(50))
    assert tree.paths(spark.createDataFrame([], have)).count() == 0
    assert tree.paths(spark.createDataFrame([*chain[:3], ("x", "gone", "x", 0), ("y", "x", "y", 0)], have)).count() == 3
    for loop in ([("a", "b", "a", 0), ("b", "a", "b", 0)], [("n0", "n2", "s", 0)]):
        with pytest.raises(ValueError):
            tree.paths(spark.createDataFrame([*chain[:3], *loop], have))
    wide = spark.createDataFrame([*[(f"r{i}", None, f"r{i}", i) for i in range(3)], *[(f"c{i}", f"r{i % 2}", f"c{i}", i) for i in range(2000)]], have)
    walk = tree.preorder(tree.paths(wide).withColumn("root", F.substring_index("path", "/", 1)), F.col("root")).collect()
    for root in ("r0", "r1", "r2"):
        own = [r for r in walk if r.root == root]
        assert [r.sort_path for r in sorted(own, key=lambda r: r.sort_order)] == sorted(r.sort_path for r in own) and {r.sort_order for r in own} == set(range(len(own)))


def test_walks_of_odd_trees(spark):
    """Null, negative, equal and 11-digit ordinals; orphans; intervals and sort paths against a recursive walk."""
    rng = random.Random(3)
    ords = [None, -5, 0, 7, 7, 12345678900, 12345678901, -12345678901]
    rows = [(f"n{i}", None if i % 40 == 0 else f"n{rng.randrange(max(0, i - 30), i)}" if i % 17 else "gone", f"s{i}", rng.choice(ords)) for i in range(400)]
    children = {}
    for r in rows:
        children.setdefault(r[1], []).append(r)
    want = {}

    def walk(node, root, depth, at):
        here = at
        for child in sorted(children.get(node[0], []), key=lambda r: (r[3] is not None, r[3] or 0, r[0])):
            at = walk(child, root, depth + 1, at + 1)
        want[node[0]] = (node[1], root, depth, here, at)
        return at

    for top in children[None]:
        walk(top, top[0], 1, 0)
    nodes = spark.createDataFrame(rows, "id string, parent string, slug string, ord long")
    tree_rows = tree.intervals(nodes)
    assert {r.id: (r.parent, r.root, r.depth, r.enter, r.leave) for r in tree_rows.collect()} == want
    walked = tree.preorder(tree.paths(nodes).withColumn("root", F.substring_index("path", "/", 1)), F.col("root")).collect()
    assert {r.id: (r.depth, r.sort_order) for r in walked} == {k: (v[2], v[3]) for k, v in want.items()}
    for k in ("n0", "n1", "n40", "absent"):
        assert {r.id for r in tree.below(tree_rows, k).collect()} == {i for i, v in want.items() if k in want and v[1] == want[k][1] and want[k][3] <= v[3] <= want[k][4]}


def test_a_chain_takes_few_rounds(spark, tmp_path):
    rows = [(i, i - 1 if i else None, None) for i in range(10_000)]
    nodes = spark.createDataFrame(rows, "id long, parent long, ord long")
    assert {(r.id, r.depth, r.enter, r.leave) for r in tree.intervals(nodes).collect()} == {(i, i + 1, i, 9999) for i in range(10_000)}
    assert tree._Doubling(Workspace(spark, "test"), nodes.drop("ord"), {}).rounds < 20
    with pytest.raises(ValueError):
        tree.intervals(nodes.unionByName(spark.createDataFrame([(20_000, 20_001, None), (20_001, 20_000, None)], nodes.schema)))


def test_rate_limit_counts(spark):
    rows = spark.createDataFrame([("10.0.0.99", 0), ("10.0.0.99", 60), ("10.0.0.99", 120), ("10.0.0.1", 90), ("10.0.0.99", 3700)], "ip string, s long")
    got = {(r.ip, r.s): r.recent for r in logs.recent_count(rows, "ip", F.col("s") * 1_000_000, 60).collect()}
    assert got == {("10.0.0.99", 0): 0, ("10.0.0.99", 60): 1, ("10.0.0.99", 120): 2, ("10.0.0.1", 90): 0, ("10.0.0.99", 3700): 1}


def test_index_at_every_stop(spark, tmp_path, monkeypatch):
    """Whatever step of a refresh, build or compaction fails, the state before stands as a whole; a second writer is refused."""
    have = "id int, text string"
    old, new = [(1, "alpha beta"), (2, "beta gamma"), (3, "alpha")], [(1, "alpha delta"), (4, "delta")]
    index = search.PhraseIndex(spark, f"file://{tmp_path}/i").build(spark.createDataFrame(old, have), "id", ["text"])
    ids = lambda i, q: sorted(r.key for r in i.find(q).collect())
    before = {q: ids(index, q) for q in ("alpha", "beta", "delta")}
    changed, gone = spark.createDataFrame(new, have), spark.createDataFrame([(3,)], "id int")
    write, commit = Snapshots.write, Snapshots.commit
    for stop in range(4):
        left = [stop]

        def failing(f):
            def run(self, *args, **options):
                if not left[0]:
                    raise OSError("stopped")
                left[0] -= 1
                return f(self, *args, **options)

            return run

        with monkeypatch.context() as m:
            m.setattr(Snapshots, "write", failing(write))
            m.setattr(Snapshots, "commit", failing(commit))
            with pytest.raises(OSError):
                index.refresh(changed, gone, "id", ["text"])
        other = search.PhraseIndex(spark, f"file://{tmp_path}/i")
        assert {q: ids(other, q) for q in before} == before and other.snapshots.numbers() == [1]
    pinned = index.snapshots.state()
    index.refresh(changed, gone, "id", ["text"])
    assert {q: ids(index, q) for q in before} == {"alpha": [1], "beta": [2], "delta": [1, 4]}
    with pytest.raises(Conflict):
        index.snapshots.commit(pinned, facts={"gen": 9})
    assert index.snapshots.state(1)["facts"]["gen"] == 0 and len(index.snapshots.state()["tables"]["postings"]) == 2
    index.compact()
    assert {q: ids(index, q) for q in before} == {"alpha": [1], "beta": [2], "delta": [1, 4]} and len(index.snapshots.state()["tables"]["postings"]) == 1
    assert index.snapshots.vacuum(older_than=3600) == [] and index.snapshots.numbers() == [3]
    assert len(index.snapshots.vacuum(older_than=-1)) == 11 and ids(index, "delta") == [1, 4]


def test_index_of_many_blocks(spark, tmp_path, monkeypatch):
    """Blocks of few documents and tokens, odd texts, repeated words: finds, many queries and snippets are those of the scan."""
    monkeypatch.setattr(search, "BLOCK_DOCS", 3)
    monkeypatch.setattr(search, "BLOCK_TOKENS", 40)
    rng = random.Random(9)
    words = ["alpha", "Beta", "café", "café", "x-y", "(z)", "½", "12", "", "\n", "the", "the", "ŉ", "ﬁ"]
    rows = [(i, rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(60)))]), rng.choice([None, "the beta", "«X» y"])) for i in range(120)]
    table = spark.createDataFrame(rows, "id int, text string, head string").repartition(2)
    index = search.PhraseIndex(spark, f"file://{tmp_path}/i").build(table, "id", ["text", "head"])
    queries = ["the", "the the", "the-the", "alpha-beta", "cafe", "x-y 12", "the-the-the alpha", "beta x", "½", "absent the"]
    for q in queries:
        for fields in (["text", "head"], ["text"], ["head"]):
            assert sorted(r.key for r in index.find(q, fields).collect()) == sorted(r.id for r in table.where(search.matches(q, *fields)).collect()), (q, fields)
        if len(q.split()) == 1:
            want = {tuple(r) for r in table.where(search.matches(q, "text")).select("id", search.snippet(F.col("text"), F.lit(q), 5)).collect()}
            assert {tuple(r) for r in index.snippets(index.find(q, ["text"]), table, "id", "text", 5).collect()} == want, q
    asked = spark.createDataFrame(list(enumerate([*queries, "", "§"])), "query int, text string")
    want = {(i, r.id) for i, q in enumerate(queries) for r in table.where(search.matches(q, "text", "head")).collect()}
    assert {tuple(r) for r in index.find_each(asked, table, "id", ["text", "head"]).collect()} == want
    assert {tuple(r) for r in search.scan_each(asked, table, "id", ["text", "head"]).collect()} == want


def test_searches_with_and_without_an_index(spark, sf_dir):
    """Queries give the same rows whether the index is there or not."""
    names = ["phrase_search", "multi_phrase_search", "snippet_window", "search_scoped", "global_search"]
    run = lambda: {n: sorted(map(str, plans.QUERIES[n](spark, sf_dir).collect())) for n in names}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(searches, "index", lambda *_: None)
        scanned = run()
    plans.QUERIES["index_build"](spark, sf_dir).collect()
    assert searches.index(spark, sf_dir) is not None and run() == scanned
    plan = plans.QUERIES["phrase_search"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token" in plan


def test_index_is_smaller_than_the_texts(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    search.PhraseIndex(spark, f"file://{tmp_path}/i").build(table, "doc_id", ["text"])
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert size < table.agg(F.sum(F.octet_length("text"))).first()[0]


def test_look_up(spark):
    have = "id string, name string, type string, state string"
    cached = spark.createDataFrame([("ca-palm", "Palm Desert", "city", "CA")], have)
    catalog = spark.createDataFrame([("r1", "Oakville", "city", "CA", "municode"), ("r2", "Elm Town", "town", "CA", None), ("r3", "Kern County", "county", "CA", "ecode360"), ("r0", "Oakville", "city", "NV", None), ("r9", "Palm Desert", "city", "CA", "x")], have + ", publisher string")
    gazetteer = spark.createDataFrame([("g1", "Bigfork", "city", "MT"), ("g2", "Nowhere", "city", "MT"), ("g3", "Oakville", "city", "CA")], have)
    published = spark.createDataFrame([("amlegal", "bigfork"), ("municode", "ca-elm-town"), ("amlegal", "elm_town")], "publisher string, id string")
    rows = [
        (1, "palm-desert", None, None, "ca", None), (2, None, "Palm Desert", None, "CA", None), (3, None, "OAKVILLE", None, "CA", None), (4, None, None, "Kern", "CA", None), (5, None, None, "Oakville", "CA", None), (6, None, "Elm Town", None, "CA", None),
        (7, None, None, None, None, "12 Main Street Bigfork, MT 59911"), (8, None, "Nowhere", None, "MT", None), (9, None, "Atlantis", None, "CA", None), (10, None, "Oakville", None, None, None), (11, None, None, None, "CA", None), (12, None, "Oakville", None, "NV", None),
    ]
    asked = spark.createDataFrame(rows, "query int, slug string, city string, county string, state string, address string")
    got = {r.query: (r.status, r.step, r.id, r.publisher, r.source_id) for r in resolve.look_up(asked, cached, catalog, gazetteer, published).collect()}
    assert got[1] == got[2] == ("ready", "cached", "ca-palm", None, None)
    assert got[3] == ("known", "catalog", "r1", "municode", None) and got[4][:3] == ("known", "catalog", "r3") and got[5][0] == "not_found"
    assert got[6] == ("discovered", "catalog", "r2", "municode", "ca-elm-town") and got[8][:3] == ("not_found", "gazetteer", "g2")
    assert got[9][:3] == ("not_found", None, None) and got[10][0] == got[11][0] == "bad_request" and got[12][:3] == ("not_found", "catalog", "r0") and got[7][0] in ("discovered", "not_found")


def test_search_code(spark):
    hits = spark.range(40).select(F.col("id").alias("key"))
    sections = spark.range(60).select(F.col("id").alias("key"), F.concat(F.lit("j"), (F.col("id") % 3).cast("string")).alias("jurisdiction_id"), (F.col("id") % 2).cast("string").alias("code_id"))
    places = spark.createDataFrame([("j0", "Zero", "CA", True), ("j1", "One", "ca", True), ("j2", "Two", "CA", False)], "id string, name string, state string, usable boolean")
    keys = lambda *a, **k: [r.key for r in search.search_code(hits, sections, places, *a, **k).collect()]
    assert keys("j2") == list(range(2, 32, 3)) and keys("j2", "1") == [5, 11, 17, 23, 29, 35] and keys("absent") == [] and keys("j0", limit=-1) == []
    assert keys() == list(range(0, 30, 3)) and keys(state="CA", limit=16) == [*range(0, 40, 3), 1, 4] and keys(state="NY") == []


def test_the_gate_stops_a_bad_run(spark):
    rows = spark.range(10).select("id", (F.col("id") < 3).alias("bad"))
    with pytest.raises(ValueError, match="3 of 10"):
        changes.require_resolved(rows, F.col("bad"))
    assert changes.require_resolved(rows.where("id > 0"), F.col("bad"), 0.25).count() == 9 and changes.require_resolved(rows.where("id > 99"), F.col("bad")).count() == 0
