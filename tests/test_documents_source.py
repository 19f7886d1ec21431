"""Contents and sections from saved trees, XML documents, as-of joins and the JSON catalog."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexspan.functions.text import paragraphs_of_html
from lexspan.operators import asof
from lexspan.sources import documents


def nested(depth, path="d0"):
    node = {"path": path, "slug": path.rsplit("/", 1)[-1], "level": "part", "num": str(depth), "hasContent": depth == 1}
    return node if depth == 1 else node | {"heading": "H", "children": [nested(depth - 1, f"{path}/d{depth}")]}


def test_a_tree_of_depth_20(spark, tmp_path):
    root = tmp_path / "codes"
    for name, toc in (("ca-x", {"children": [nested(20), {"path": "s1", "slug": "s1", "level": "section", "num": "§ 1", "heading": "One", "hasContent": True}, {"path": "s 2", "hasContent": True}]}), ("empty", {"children": []}), ("none", {"title": "x"})):
        (root / name).mkdir(parents=True)
        (root / name / "_toc.json").write_text(json.dumps(toc))
    (root / "bad").mkdir()
    (root / "bad" / "_toc.json").write_text("{not json")
    deep = nested(20)
    while deep.get("children"):
        deep = deep["children"][0]
    at = root / "ca-x" / f"{deep['path']}.html"
    at.parent.mkdir(parents=True)
    at.write_text("<p>Deep &amp; text</p>")
    (root / "ca-x" / "s1.xml").write_text("<lawDoc/>")
    (root / "ca-x" / "s1.html").write_text("<p>One</p>")
    (root / "ca-x" / "lost.html").write_text("<p>Lost</p>")
    nodes, sections, problems = documents.import_tree(spark, str(root))
    rows = nodes.orderBy("sort_order").collect()
    assert len(rows) == 22 and [r.sort_order for r in rows] == list(range(22)) and [r.depth for r in rows] == [*range(1, 21), 1, 1]
    assert rows[19].path == deep["path"] and rows[19].parent_path == rows[18].path and rows[19].has_content and not rows[0].has_content and rows[21].heading == ""
    found = {r.path: r for r in sections.collect()}
    assert set(found) == {deep["path"], "s1"} and found[deep["path"]].text.strip() == "Deep & text" and found[deep["path"]].heading is None and found["s1"].xml == "<lawDoc/>" and found["s1"].heading == "One"
    assert {tuple(r) for r in problems.collect()} == {("bad", "corrupt contents", None), ("empty", "empty contents", None), ("none", "empty contents", None), ("ca-x", "node without file", "s 2"), ("ca-x", "file without node", "lost")}


def test_xml_documents_to_rows(spark):
    nested_xml = '<lawDoc xmlns="x" identifier="/a"><main><section identifier="/a/1" temporalId="s1"><num>1</num><heading>H &lt;x&gt;</heading><content><p>top</p></content><subsection><num>(a)</num><content><p>one</p><p>two</p></content><paragraph><num>(1)</num><subparagraph><num>(A)</num><clause><num>(i)</num><subclause><num>(I)</num><item><num>(aa)</num><content><p>leaf</p></content></item></subclause></clause></subparagraph></paragraph></subsection><subsection><num>(b)</num></subsection></section></main></lawDoc>'
    html = "<p>Fish &amp; chips</p><p> second </p>"
    made = spark.createDataFrame([(3, html)], "id int, html string").select("id", documents.uslm(F.lit("ca-x"), F.lit("title-1"), F.lit("1.2"), F.lit("Q & A"), paragraphs_of_html(F.col("html"))).alias("xml"))
    docs = spark.createDataFrame([(1, nested_xml), (2, "<lawDoc"), (4, None), (5, "<lawDoc/>")], "id int, xml string").unionByName(made)
    rows = documents.uslm_rows(docs, "id", "xml").collect()
    one = sorted((r for r in rows if r.key == 1), key=lambda r: r.place)
    assert [(r.type, r.num or r.text) for r in one] == [("section", "1"), ("text", "top"), ("subsection", "(a)"), ("text", "one"), ("text", "two"), ("paragraph", "(1)"), ("subparagraph", "(A)"), ("clause", "(i)"), ("subclause", "(I)"), ("item", "(aa)"), ("text", "leaf"), ("subsection", "(b)")]
    assert {r.key for r in rows} == {1, 3} and {(r.identifier, r.heading) for r in rows if r.key == 3 and r.type == "section"} == {("/ca-x/title-1/section-1.2", "Q & A")}
    assert {(r.key, r.body) for r in documents.text_of(documents.uslm_rows(docs, "id", "xml")).collect()} == {(1, "top\none\ntwo\nleaf"), (3, "Fish & chips\nsecond")}


@pytest.mark.parametrize("partitions", [1, 7])
def test_as_of_equals_a_search(spark, partitions):
    """Equal times, ties, null keys and times, a key with most of the rows, keys of one side only, clashing names."""
    rng = random.Random(5)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", "c", None])
    left = [(i, key(), rng.choice([None, *range(60)]), "l") for i in range(800)] + [(900, "left only", 5, "l")]
    right = [(i, key(), rng.choice([None, *range(60)]), rng.randrange(3)) for i in range(700)] + [(999, "right only", 5, 1)]
    a = spark.createDataFrame(left, "id int, k string, t int, __row string").repartition(partitions)
    b = spark.createDataFrame(right, "id int, k string, t int, seq int").repartition(partitions)

    def best(k, t):
        found = [(r[2], r[3], r[0]) for r in right if k is not None and t is not None and r[1] == k and r[2] is not None and r[2] <= t]
        return max(found)[2] if found else None

    spark.conf.set("spark.sql.shuffle.partitions", "6")
    got = {r.id: r.found.id if r.found else None for r in asof.as_of(a, b, "k", "t", "t", ["seq", "id"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: best(k, t) for i, k, t, _ in left}


def test_versions_in_force(spark):
    versions = spark.createDataFrame([("s", 1, 10, None, False), ("s", 2, 20, 25, False), ("s", 3, 30, None, True), ("u", 4, 5, 6, None)], "k string, v int, starts int, ends int, gone boolean")
    asked = spark.createDataFrame([("s", t) for t in (9, 10, 19, 20, 24, 25, 30, 99)] + [("u", 5), ("u", 6), ("x", 1)], "k string, at int")
    got = {(r.k, r["at"]): r.found.v if r.found else None for r in asof.in_force(asked, versions, "k", "at", "starts", "ends", F.col("gone")).collect()}
    assert got == {("s", 9): None, ("s", 10): 1, ("s", 19): 1, ("s", 20): 2, ("s", 24): 2, ("s", 25): None, ("s", 30): None, ("s", 99): None, ("u", 5): 4, ("u", 6): None, ("x", 1): None}


def test_a_pretty_catalog(spark, tmp_path):
    rows = [("b", None, [1, 2]), ("a", "Ünï \"q\"\nx", []), ("c", "", None)]
    documents.write_catalog(spark.createDataFrame(rows, "id string, name string, tags array<int>").repartition(3), f"file://{tmp_path}/c", F.col("id"))
    (part,) = (tmp_path / "c").glob("part-*")
    text = part.read_text()
    assert json.loads(text) == [{"id": i, "name": n, "tags": t} for i, n, t in sorted(rows)] and text.startswith("[\n  {\n") and '    "id" : "a"' in text
