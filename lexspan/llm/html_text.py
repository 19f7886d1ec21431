"""Main text of web pages: blocks of a tolerant HTML scan, compared with the page at the nearest URL of the same host."""

from __future__ import annotations

import html
import re
import struct
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import blake2b
from heapq import nsmallest
from itertools import chain, groupby
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, Workspace, one_each, ranked

#: Pages of consecutive URLs that one task compares with their neighbours, and the most such runs there are; runs get longer
#: beyond that, so that the list of their first pages, which goes to every task, stays bounded.
RUN_PAGES, MAX_RUNS = 2_000, 10_000
#: A neighbour that shares at least this part of a page's characters outside named furniture is a copy as a rule.
COPY_SHARE = 0.8
#: Hashes of words kept of each line. If a host has copies only, pages whose unshared lines have so many words each in
#: these samples, less than half of them common, hold another text in the same template.
WORD_SAMPLE, LEAST_WORDS = 8, 5
_LINE = struct.Struct(f"<QIB{WORD_SAMPLE}I")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_BLOCK = frozenset("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text; of these the raw ones end at their own end tag only.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_JUNK = frozenset("nav aside footer form dialog menu button select option noscript template svg canvas audio video object applet datalist head fieldset".split()) | _RAW
_JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that name page furniture, reader comments and notices.
_JUNK_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login register "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget related recommended recommendations share sharing social footer masthead pagination pager toolbar toc comment comments commentlist disqus discussion respond reply replies disclaimer skip".split()
)
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


@dataclass
class Block:
    text: str
    inside: bool  # within the page's article or main element
    junk: bool  # within page furniture


def _is_junk(tag: str, attributes: str, rooted: bool) -> bool:
    if tag in _JUNK or (tag == "header" and not rooted):
        return True
    if not attributes or tag in ("body", "html", "article", "main") and not rooted:
        return False
    if _HIDDEN.search(attributes):
        return True
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "role":
            if value.strip().lower() in _JUNK_ROLES:
                return True
        elif name.lower() != "aria-label" and any(n.lower() in _JUNK_NAMES for n in _NAME.findall(value)):
            return True
    return False


def blocks_of(page: str | None) -> list[Block]:
    """All text blocks of a page in order, references decoded and white space made single; br is white space."""
    page = page or ""
    found: list[Block] = []
    held: list[str] = []
    junk = ""  # the tag whose element is furniture, and how deep it is nested in itself
    depth = root = 0
    root_tag = ""

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        if text:
            found.append(Block(text, root > 0, bool(junk)))
        held.clear()

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        held.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        end, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        alone = tag in _VOID or (attributes.endswith("/") and tag not in _BLOCK and tag not in _RAW)
        if tag in _BLOCK or tag in _JUNK:
            close()
        elif tag == "br":
            held.append(" ")
        if junk:
            if junk in ("p", "li", "option") and tag in _BLOCK and tag != "option" and not (junk == "li" and tag in ("ul", "ol", "p", "div")):
                junk = ""  # these end where another block begins or the one around them ends
            elif tag == junk and not alone:
                depth += -1 if end else 1
                if depth == 0:
                    close()
                    junk = ""
                    continue
            if junk:
                if tag in _RAW and not end:
                    at = _after(page, tag, at)
                continue
        if end:
            if tag == root_tag and root:
                root -= 1
            continue
        if not alone and _is_junk(tag, attributes, root > 0):
            close()
            junk, depth = tag, 1
            if tag in _RAW:
                at = _after(page, tag, at)
                junk = ""
        elif tag in ("article", "main") and (not root or tag == root_tag):
            root, root_tag = root + 1, tag
    close()
    return found


def _after(page: str, tag: str, at: int) -> int:
    """Behind the end tag of a raw element, or the page's end."""
    m = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
    return m.end() if m else len(page)


def _rows(a: Sequence, masks: dict, width: int) -> list[int]:
    """After each line of `a` the row of the longest-common-subsequence matrix as a number: bit j is 0 where the row rises at
    column j. A row takes a few operations on whole numbers, however often lines repeat."""
    full = (1 << width) - 1
    rows = [full]
    for line in a:
        v, hit = rows[-1], rows[-1] & masks[line]
        rows.append((v + hit | v - hit) & full)
    return rows


def _last_row(a: Sequence, b: Sequence) -> np.ndarray:
    """Length of the longest common subsequence of `a` and each beginning of `b`."""
    masks = _masks(b)
    v, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    for line in a:
        if hit := v & masks.get(line, 0):
            v = (v + hit | v - hit) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little", count=len(b))
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _masks(b: Sequence) -> dict:
    masks: dict = defaultdict(list)
    for j, line in enumerate(b):
        masks[line].append(j)
    out = {}
    for line, places in masks.items():
        bits = np.zeros(places[-1] + 1, np.uint8)
        bits[places] = 1
        out[line] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def common_lines(a: Sequence, b: Sequence, cells: int = 1 << 30) -> list[int]:
    """Places in `a` of a longest common subsequence of two lists of lines.

    Equal beginnings and ends are cut, lines of one list alone left out; the rest goes through the bit-parallel matrix,
    len(a) * len(b) / 64 steps whatever repeats. A matrix of more than `cells` bits is halved first (Hirschberg).
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [*range(head)], [*range(len(a) - tail, len(a))]
    known = set(b[head : len(b) - tail])
    places = [i for i in range(head, len(a) - tail) if a[i] in known]
    x, own = [a[i] for i in places], {a[i] for i in places}
    y = [line for line in b[head : len(b) - tail] if line in own]
    out: list[int] = []
    if not x:
        pass
    elif len(x) * len(y) > cells:
        half = len(x) // 2
        at = int((_last_row(x[:half], y) + _last_row(x[half:][::-1], y[::-1])[::-1]).argmax())
        out = [places[i] for i in common_lines(x[:half], y[:at], cells)] + [places[half + i] for i in common_lines(x[half:], y[at:], cells)]
    else:
        rows, i, j = _rows(x, _masks(y), len(y)), len(x), len(y)
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append(places[i])
        out.reverse()
    return ends[0] + out + ends[1]


@dataclass
class Lines:
    """A page's lines outside furniture as the comparison sees them: a hash, a length and a sample of words for each."""

    keys: tuple[int, ...]
    sizes: tuple[int, ...]
    words: tuple[tuple[int, ...], ...]  # the least WORD_SAMPLE hashes of each line's words

    def pack(self) -> bytes:
        return b"".join(_LINE.pack(k, n, len(w), *w, *(0,) * (WORD_SAMPLE - len(w))) for k, n, w in zip(self.keys, self.sizes, self.words, strict=True))

    @staticmethod
    def unpack(data: bytes) -> Lines:
        rows = list(_LINE.iter_unpack(data))
        return Lines(tuple(r[0] for r in rows), tuple(r[1] for r in rows), tuple(r[3 : 3 + r[2]] for r in rows))


def lines_of(page: list[Block]) -> Lines:
    texts = [b.text for b in page if not b.junk]
    keys = tuple(int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest()) for t in texts)
    words = tuple(tuple(nsmallest(WORD_SAMPLE, {crc32(w.encode("utf-8", "surrogatepass")) for w in t.split()})) for t in texts)
    return Lines(keys, tuple(min(len(t), 2**32 - 1) for t in texts), words)


def _shared(a: Lines, b: Lines) -> tuple[list[int], int]:
    found = common_lines(a.keys, b.keys)
    return found, sum(a.sizes[i] for i in found)


def _apart(a: Lines, b: Lines) -> bool:
    """Whether what two pages don't share is another text on each side, not an edit of the same one (a date, a word)."""
    common = _shared(a, b)[0]
    held = Counter(a.keys[i] for i in common)
    rests = []
    for page in (a, b):
        left, rest = held.copy(), set()
        for key, words in zip(page.keys, page.words, strict=True):
            if left[key] > 0:
                left[key] -= 1
            else:
                rest.update(words)
        rests.append(rest)
    least = min(map(len, rests))
    return least >= LEAST_WORDS and 2 * len(rests[0] & rests[1]) < least


def groups_of(pages: list[Lines]) -> list[tuple[int, int]]:
    """For each page of a host in URL order its copy group and its text group, counted from 0.

    A page joins the copy group before it if it and the group's first page share COPY_SHARE of the larger one. Within a
    copy group a new text begins where a page is apart from the text's first page. Each page is compared with one page
    of each kind, so groups of any size take linear time.
    """
    out: list[tuple[int, int]] = []
    group = text = -1
    first = first_text = None
    for page in pages:
        if first is None or page.keys != first.keys and _shared(page, first)[1] < COPY_SHARE * max(sum(page.sizes), sum(first.sizes)):
            group, text, first, first_text = group + 1, text + 1, page, page
        elif page.keys != first_text.keys and _apart(page, first_text):
            text, first_text = text + 1, page
        out.append((group, text))
    return out


def shared_with(page: Lines, others: Iterable[Lines], same: Iterable[Lines] = ()) -> set[int]:
    """Lines that the page shares, in order, with the first of `others` that isn't a copy of it.

    If all are copies, the first of `others` and then of `same` (pages of its copy group) decides whose unshared lines
    are another text: such pages consist of their template for the most part.
    """
    if not page.keys:
        return set()
    size, held = sum(page.sizes), []
    for other in others:
        found, n = _shared(page, other)
        if n < COPY_SHARE * size:
            return set(found)
        held.append(other)
    for other in chain(held, same):
        if other.keys != page.keys and _apart(page, other):
            return set(_shared(page, other)[0])
    return set()


def kept_text(page: list[Block], shared: set[int]) -> tuple[str, int]:
    """The blocks outside furniture without the shared ones outside the article or main element, and how many those are."""
    lines = [b for b in page if not b.junk]
    gone = {i for i in shared if not lines[i].inside}
    return "\n".join(b.text for i, b in enumerate(lines) if i not in gone), len(gone)


def main_text(page: list[Block], neighbours: list[list[Block]]) -> tuple[str, int]:
    """The page's main text, and how many lines the comparison deleted.

    Furniture goes. Lines shared with the neighbour go too, except within the page's own article or main element:
    what is shared there (a passage, a licence) is text of both pages. Unshared lines stay wherever they are, so a
    story beside a teaser's article, or a lead before the article, is main text.
    """
    return kept_text(page, shared_with(lines_of(page), map(lines_of, neighbours)))


def _nearness(a: str, b: str) -> int:
    """Leading path segments that two paths have in common."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def _outward(at: int, groups: list[int], paths: list[str], low: int, high: int) -> Iterator[int]:
    """Nearest page of each other group within [low, high), before and after `at`; at each step the longer common path first."""
    before, after = at, at
    while True:
        # groups are runs of equal numbers, so their ends are found by bisection
        before = bisect_left(groups, groups[before], low, before + 1) - 1 if before >= low else before
        after = bisect_right(groups, groups[after], after, high) if after < high else after
        step = [i for i in (before, after) if low <= i < high]
        if not step:
            return
        yield from sorted(step, key=lambda i: -_nearness(paths[at], paths[i]))


def _shared_lines(pages: list[Lines], paths: list[str], wanted: list[bool]) -> Iterator[set[int]]:
    """shared_with() for every wanted page of a host, given in URL order; the others get an empty set."""
    found = groups_of(pages) if any(wanted) else []
    copies, texts = [g for g, _ in found], [t for _, t in found]
    for i, page in enumerate(pages):
        if not wanted[i]:
            yield set()
            continue
        low, high = bisect_left(copies, copies[i]), bisect_right(copies, copies[i])
        others = (pages[j] for j in _outward(i, copies, paths, 0, len(pages)))
        same = (pages[j] for j in _outward(i, texts, paths, low, high))
        yield shared_with(page, others, same)


def _edges(pages: list[Lines]) -> tuple[list[int], bool]:
    """Places of the pages that stand for a host's last pages: the last one of the last text, of the text before it and of
    the copy group before; and whether there is such a group."""
    found = groups_of(pages)
    last_group, last_text = found[-1]
    places = {len(pages) - 1}
    places |= {i for i in (bisect_left(found, last_text, key=lambda x: x[1]) - 1, bisect_left(found, last_group, key=lambda x: x[0]) - 1) if i >= 0}
    return sorted(places, reverse=True), last_group > 0


def _contexts(edges: list[tuple], runs: int) -> dict[int, dict[bytes, tuple]]:
    """The pages beyond a run's end that each run also looks at, by their lines' digest. `edges` has rows of run, host, whole
    (the run has this host only), several (copy groups) and a list of (digest, key), nearest first, of each run's end.

    Runs that are one copy group are passed through, one page of each text, until the host has another group or ends.
    """
    of = {e[0]: e[1:] for e in edges}
    out: dict[int, dict[bytes, tuple]] = {}
    held: dict[bytes, tuple] = {}
    host = None
    for run in range(runs):
        if run not in of:  # an empty run
            out[run] = held
            continue
        end_host, whole, several, keys = of[run]
        out[run] = held
        if several or not whole or end_host != host:
            held = {}
        held = held | dict(keys)
        host = end_host
    return out


def extract(pages: DataFrame, run_pages: int = RUN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars and n_shared (lines deleted by comparison) for every page.

    Pages are ranked by host, path, whole URL and page_id, and cut into runs of `run_pages`. A page's neighbour is the
    nearest page of its host that isn't a copy of it (see shared_with), before or after it, the longer common path first.
    One page of each copy group is looked at, through the whole run and the pages that stand for the runs around it.

    Defined cases: a null or empty html has an empty text; null and odd URLs have no host and are neighbours of each other;
    repeated rows are copies and don't count as neighbours for each other; other columns are not read.

    Ranks come from a range sort of the keys alone with distributed prefix sums, so a host of any size is spread over
    tasks; the first keys of all runs (MAX_RUNS at most) then tell each page its run. If there are several runs, a first
    pass over hashes of lines finds up to three pages at each end of a run, whose keys go through the driver; these pages
    are also dealt to the runs that need them. The pages themselves are shuffled once.
    """
    ws = Workspace(pages.sparkSession, "html")
    url = F.coalesce("url", F.lit(""))
    pattern = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)"
    order = ["host", "path", "u", "id"]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.lower(F.regexp_extract(url, pattern, 1)).alias("host"), F.regexp_extract(url, pattern, 2).alias("path"), url.alias("u"), F.coalesce(F.col("page_id").cast("long"), F.lit(LAST_ID)).alias("id"))
    keys = ranked(ws, rows.select(*order), [F.col(c) for c in order], "rank")
    step = max(run_pages, -(-keys.count() // MAX_RUNS))
    firsts = sorted(tuple(r) for r in keys.where((F.col("rank") > 0) & (F.col("rank") % step == 0)).select(*order).collect())

    @F.pandas_udf("int")
    def run_of(host: pd.Series, path: pd.Series, u: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(firsts, k) for k in zip(host, path, u, i, strict=True)], dtype="int32")

    keys_of = one_each(len(firsts) + 1)

    @F.pandas_udf("int")
    def place_of(run: pd.Series) -> pd.Series:
        return pd.Series(keys_of[run.to_numpy()], dtype="int32")

    def rows_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list]:
        for batch in batches:
            yield from map(list, zip(*(batch.column(c).to_pylist() for c in names), strict=True))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [lines_of(blocks_of(page)).pack() for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("run", *order)), pa.array(made, pa.binary())], names=["run", *order, "lines"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["run", "forward", "place", "whole", "several", *order, "digest"]
        types = (pa.int32(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        for run, found in groupby(rows_of(batches, ["run", *order, "lines"]), key=lambda r: r[0]):
            hosts, first = 0, []
            for _, of_host in groupby(found, key=lambda r: r[1]):
                last = list(of_host)
                hosts, first = hosts + 1, first or last
            made = []
            for forward, side in ((True, last), (False, first[::-1])):
                places, several = _edges([Lines.unpack(r[5]) for r in side])
                made += [(run, forward, n, hosts == 1, several, *side[i][1:5], blake2b(side[i][5], digest_size=16).digest()) for n, i in enumerate(places)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(made: list[tuple]) -> pa.RecordBatch:
            columns = zip(*made, strict=True) if made else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "url", "text", "n_chars", "n_shared"])

        made = []
        for _, found in groupby(rows_of(batches, ["page_id", "url", "path", "host", "run", "own", "html"]), key=lambda r: r[3:5]):
            of_host = []
            for row in found:
                row[6] = [b for b in blocks_of(row[6]) if not b.junk]
                of_host.append(row)
            # without a line outside the article nothing can be deleted
            wanted = [r[5] and not all(b.inside for b in r[6]) for r in of_host]
            lines = [lines_of(r[6]) for r in of_host] if any(wanted) else [None] * len(wanted)
            for row, shared in zip(of_host, _shared_lines(lines, [r[2] for r in of_host], wanted), strict=True):
                if row[5]:
                    text, n = kept_text(row[6], shared)
                    made.append((row[0], row[1], text, len(text), n))
                if len(made) >= 500:
                    yield out(made)
                    made = []
        yield out(made)

    dealt = rows.withColumn("run", run_of(*order)).withColumn("own", F.lit(True))
    if firsts:
        small = dealt.select("run", *order, "html").mapInArrow(sketch, "run int, host string, path string, u string, id long, lines binary")
        ends = small.withColumn("place", place_of("run")).repartition(len(keys_of), "place").sortWithinPartitions("run", *order).mapInArrow(edges, "run int, forward boolean, place int, whole boolean, several boolean, host string, path string, u string, id long, digest binary").collect()
        runs, also = len(firsts) + 1, set()
        for forward in (True, False):
            side = defaultdict(list)
            for e in sorted((e for e in ends if e.forward == forward), key=lambda e: (e.run, e.place)):
                side[e.run if forward else runs - 1 - e.run].append(e)
            listed = [(k, es[0].host, es[0].whole, es[0].several, [(bytes(e.digest), (e.host, e.u, e.id)) for e in es]) for k, es in side.items()]
            # the host at the other end of each run, which alone can use pages from beyond it
            starts = {e.run: e.host for e in ends if e.forward != forward}
            for k, near in _contexts(listed, runs).items():
                r = k if forward else runs - 1 - k
                also |= {(u, i, r) for host, u, i in near.values() if host == starts.get(r)}
        if also:
            targets = pages.sparkSession.createDataFrame(sorted(also), "u string, id long, run int")
            dealt = dealt.unionByName(rows.join(F.broadcast(targets), ["u", "id"]).withColumn("own", F.lit(False)).select(*dealt.columns))
    dealt = dealt.withColumn("place", place_of("run")).repartition(len(keys_of), "place").sortWithinPartitions("run", *order)
    return dealt.select("page_id", "url", "path", "host", "run", "own", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_shared long")
