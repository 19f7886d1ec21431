import gzip
import hashlib
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lexspan.llm.common import one_each
from lexspan.llm.html_text import blocks_of, common_lines, extract, main_text
from lexspan.llm.queries import op9_html, op10_warc
from lexspan.llm.warc import listed_files, members, parse, read_warc, write_warc


class Plain(HTMLParser):
    """Text of the article of simple pages by the standard parser: another way to the same result."""

    BLOCKS = {"article", "h1", "p", "div", "ul", "li"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.held = False, [], ""
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        self.blocks += [" ".join(self.held.split())] if self.held.split() else []
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.cut()
        if tag == "article":
            self.inside = True
        if tag == "br":
            self.held += " "

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.cut()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.held += data


def test_op9_against_the_standard_parser(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op9_html(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == "\n".join(Plain(pages[r.page_id].html).blocks) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def text(page, *others):
    return main_text(blocks_of(page), [blocks_of(o) for o in others])[0]


def test_furniture_goes():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><p>site</p></header><nav><ul><li>menu<li>more</ul></nav>
    <div class="cookie-notice">We use cookies</div><main><article><h1>Head &amp; line</h1><p>One <b>two</b><br>three&nbsp;four<p>open paragraph
    <div id="ad-1"><div>buy</div>now</div><form><p>name</p></form><blockquote>quoted</blockquote><script>if (a < b) document.write("</p>")</script>
    <aside>side</aside><table><tr><td>cell 1<td>cell 2</table><section class="comments"><article><p>I disagree</p></article></section><p hidden>no</p></article></main>
    <footer>&copy; site</footer><!-- <p>no</p> --></body></html>"""
    assert text(page) == "Head & line\nOne two three four\nopen paragraph\nquoted\ncell 1\ncell 2"
    assert text(None) == text("") == "" and text("just text  here") == "just text here"
    assert text("<p>a < b & c &lt;d&gt; &#233;&#x41;</p>") == "a < b & c <d> éA"
    assert text('<p class="notice">n<p>text</p><ul><li class=ad>x<li>kept</ul>') == "text\nkept"
    assert text("<p>cut <!-- never closed") == "cut" and text('<p title="a > b">in</p><p title="open>out</p>') == "in\nout"


def test_differencing_without_an_article():
    one = "<div>Top bar</div><p>The first story.</p><p>It goes on.</p><div>About us</div>"
    two = "<div>Top bar</div><p>Another tale.</p><div>About us</div>"
    assert text(one, two) == "The first story.\nIt goes on." and text(two, one) == "Another tale."
    assert text(one, one, two) == "The first story.\nIt goes on."  # a copy tells nothing
    assert text(one) == "Top bar\nThe first story.\nIt goes on.\nAbout us"


def test_differencing_outside_an_article():
    """The story in a div beside a teaser's article, and a lead and an end around the article, stay; shared lines outside go."""
    one = "<div>Top bar</div><div>The whole story.</div><article>Teaser one</article><div>About us</div>"
    two = "<div>Top bar</div><p>A lead.</p><article>Another tale.<p>A licence</article><p>The end.</p><div>About us</div>"
    three = "<div>Top bar</div><article>A third tale.<p>A licence</article><div>About us</div>"
    assert text(one, two) == "The whole story.\nTeaser one"
    assert text(two, three) == "A lead.\nAnother tale.\nA licence\nThe end." and text(three, two) == "A third tale.\nA licence"
    assert text(two) == "Top bar\nA lead.\nAnother tale.\nA licence\nThe end.\nAbout us"


TEMPLATE = ["Top bar", "All the news of the town and of its people", "Read our terms before you write to us", "About us and how to reach us by post"]


def page_of(*story):
    return "".join(f"<div>{x}</div>" for x in (*TEMPLATE[:2], *story, *TEMPLATE[2:]))


STORIES = ["The mayor opened a new bridge over the river on Monday morning.", "Heavy rain closed seven schools in northern villages yesterday.", "Farmers expect their best harvest since records began here.", "A lost dog walked forty miles home across two mountain passes.", "Police found stolen paintings inside an abandoned bakery cellar."]


def test_short_stories_in_a_long_template():
    """The template is over 80 % of each page, so all are copies by characters; their unshared lines are other texts."""
    assert text(page_of("Rain fell on six small roofs."), page_of("Nobody saw who took that ladder.")) == "Rain fell on six small roofs."
    # an edited date or word in a long story makes no other text
    long = [f"{x} {n}" for n in range(4) for x in STORIES]
    assert text(page_of("Seen on 3 May", *long), page_of("Seen on 4 May", *long)) == "\n".join([*TEMPLATE[:2], "Seen on 3 May", *long, *TEMPLATE[2:]])


@pytest.mark.parametrize("run_pages", (1, 2, 3, 5, 1000))
def test_neighbours_beyond_copies_and_runs(spark, run_pages):
    """Copies at neighbouring URLs, a template-heavy host and hosts cut by runs: every page loses its template."""
    long = [[f"{x} {n}" for x in STORIES[n:] + STORIES[:n]] for n in range(3)]
    texts = {("copies.example", i): long[n] for i, n in enumerate([0, 0, 0, 1, 1, 1, 1, 0, 2, 2, 2, 2, 2])}
    texts |= {("short.example", i): [STORIES[i % 5]] for i in range(7)}
    texts |= {("near.example", i): [f"Seen {i} times", *long[i // 4]] for i in range(8)}
    texts |= {("alone.example", 0): long[0], ("two.example", 0): long[1], ("two.example", 1): long[2]}
    rows = [(n, f"http://{host}/{i:02}", page_of(*story)) for n, ((host, i), story) in enumerate(texts.items())]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), run_pages).collect()}
    assert len(got) == len(rows)
    for n, ((host, _), story) in enumerate(texts.items()):
        assert got[n] == "\n".join([*TEMPLATE[:2], *story, *TEMPLATE[2:]] if host == "alone.example" else story), (host, n)


def slow_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("seed", range(20))
def test_common_lines_are_longest(seed):
    import random

    rng = random.Random(seed)
    a, b = ([rng.choice("abcdefg") for _ in range(rng.randrange(30))] for _ in range(2))
    found = common_lines(a, b)
    rest = iter(b)
    assert found == sorted(set(found)) and all(a[i] in rest for i in found) and len(found) == slow_lcs(a, b)
    halved, rest = common_lines(a, b, cells=20), iter(b)
    assert halved == sorted(set(halved)) and all(a[i] in rest for i in halved) and len(halved) == len(found)


def test_lines_that_repeat_often():
    """Two long tables of equal cells take no more time than other pages."""
    import time

    a, b = ["x", *["0"] * 10_000, "y"], ["z", *["0"] * 9_000, "w", *["0", "1"] * 1_000]
    start = time.process_time()
    assert len(common_lines(a, b)) == 10_000 and time.process_time() - start < 5


@pytest.fixture
def pages(spark):
    big = "<p>" + "x" * 2000 + "</p>"
    rows = [(1, "http://a.example/x/1", big), (2, "http://a.example/x/2", "<p>small</p>"), (3, "http://b.example/", big), (4, None, big + "é"), (5, "no url\r\nat all", None), (6, "http://a.example/x/1", big), (7, "", "<p>small</p>"), (None, "http://c.example/", big), (8, "http://d.example", "y" * 20_000_000), (9, "http://e.example", "<p>z" * 300), (9, "http://e.example", "<p>z" * 300), (10, "u", "q" * 1000), (11, "u", "q" * 1000), (12, "u", "q" * 999), (13, "u", "q" * 999)]
    return rows, lambda n: spark.createDataFrame([(*r, 0, "c") for r in rows], "page_id long, url string, html string, shard int, keep string").repartition(n)


def test_extract_odd_rows(pages):
    rows, table = pages
    got = extract(table(3)).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert Counter(got) == Counter(extract(table(5)).collect())  # any partitioning
    assert {r.text for r in got if r.page_id == 5} == {""}
    assert extract(table(1).limit(0)).count() == 0


@pytest.mark.parametrize("n", (1, 2, 7, 300))
def test_one_key_for_each_partition(spark, n):
    keys = one_each(n)
    table = spark.createDataFrame([(int(k),) for k in keys], "k int")
    assert {r.h for r in table.select(F.pmod(F.hash("k"), F.lit(n)).alias("h")).collect()} == set(range(n))
    assert table.repartition(n, "k").select(F.spark_partition_id().alias("p")).distinct().count() == n


def slow_archive(rows):
    of = {}
    for i, _, h in rows:
        if i is not None:
            of[h or ""] = max(of.get(h or "", i), i)
    out = []
    for i, url, h in rows:
        p = (h or "").encode()
        again = len(p) >= 1000 and i is not None and of[h or ""] != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", of[h or ""] if again else None))
    return Counter(out)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_archive_odd_rows(spark, pages, tmp_path):
    rows, table = pages
    texts = []
    for n in (2, 5):
        at = f"{tmp_path}/{n}"
        manifest = write_warc(table(n), f"file://{at}", roll_bytes=300, shard_bytes=20_000)
        got = read_warc(spark, f"file://{at}", with_payload=True).collect()
        assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == slow_archive(rows)
        payloads = {(r[0], r[2] or "") for r in rows}
        assert all((r.page_id, bytes(r.payload).decode()) in payloads for r in got if r.record_type == "response")
        listed = listed_files(spark, f"file://{at}").orderBy("name").collect()
        names = [f.name for f in listed]
        assert manifest["files"] == len(names) and sum(f.records for f in listed) == len(rows) and not (tmp_path / str(n) / "_temporary").exists()
        assert len(names) > 3 and sorted(p.name for p in (tmp_path / str(n)).glob("*.warc.gz")) == names
        assert all((tmp_path / str(n) / f.name).stat().st_size == f.bytes for f in listed)
        # any gzip reader opens the files; ids ascend over files in order
        whole = b"".join(gzip.open(tmp_path / str(n) / name).read() for name in names)
        ids = [parse(m)["page_id"] for name in names for m in members((tmp_path / str(n) / name).open("rb"))]
        assert ids == sorted(i for i in ids if i is not None) + [None]
        texts.append((names, whole))
    assert texts[0] == texts[1]  # any partitioning gives the same files
    empty = f"file://{tmp_path}/empty"
    assert write_warc(table(1).limit(0), empty)["files"] == 0 and read_warc(spark, empty).count() == 0


def test_damaged_records_are_found(spark, tmp_path):
    write_warc(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("*.warc.gz")
    (data,) = members(file.open("rb"))
    assert parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        parse(data.replace(b"payload\r\n", b"pay1oad\r\n"))
    whole = file.read_bytes()
    file.write_bytes(whole[:-1])
    with pytest.raises(ValueError):
        list(members(file.open("rb")))
    with pytest.raises(Exception, match="hasn't the size"):
        read_warc(spark, f"file://{tmp_path}/w").collect()


def test_a_writing_task_may_run_again(spark, tmp_path):
    """The second run of the same archive puts the same bytes under the same names, as a retried task does."""
    table = spark.createDataFrame([(i, "u", f"<p>{i}" * 300) for i in range(60)], "page_id long, url string, html string")
    write_warc(table, f"file://{tmp_path}/w", roll_bytes=500, shard_bytes=9_000)
    before = {f.name: f.read_bytes() for f in (tmp_path / "w").glob("*.warc.gz")}
    write_warc(table.repartition(7), f"file://{tmp_path}/w", roll_bytes=500, shard_bytes=9_000)
    assert len(before) > 5 and before == {f.name: f.read_bytes() for f in (tmp_path / "w").glob("*.warc.gz")}
    assert read_warc(spark, f"file://{tmp_path}/w").count() == 60


def test_op10_against_brute_force(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert Counter(tuple(r[c] for c in COLUMNS) for r in op10_warc(spark, sf_dir).collect()) == slow_archive(rows)
