"""Scalar functions on text as column expressions: no Python runs on the rows."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ENUMS

# Words and patterns that results depend on.
PREFIX = r"(?i)^(City of|Town of|Village of|County of|Borough of)\s+"
STATE_SUFFIX = r",\s*[A-Z]{2}$"
DISPLAY_PREFIXES = ("City of ", "Town of ", "Village of ", "Borough of ", "Township of ")
PLACE_SUFFIXES = (" city", " town", " CDP", " borough", " village", " municipality")
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
LEVEL_WORDS = "|".join(ENUMS["level"])



def _folded() -> tuple[str, str]:
    """Lower-case Latin letters with accents, and their bare letters, by Unicode's own decompositions."""
    pairs = []
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        base, *marks = unicodedata.normalize("NFD", c)
        if c == c.lower() and marks and base.isascii() and all(map(unicodedata.combining, marks)):
            pairs.append((c, base))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def _chain(text: Column, pairs) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def squeeze(text: Column) -> Column:
    """White space, no-break spaces included, as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"\s+", " "))


def strip_html(html: Column) -> Column:
    """Text of markup: tags to spaces, six references decoded (ampersand first), white space squeezed."""
    return squeeze(_chain(F.regexp_replace(html, "<[^>]+>", " "), ENTITIES))


def escape_xml(text: Column) -> Column:
    return _chain(text, ESCAPES)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def make_slug(level: Column, num: Column) -> Column:
    """level-number, without a leading level word; 'untitled' where nothing is left."""
    bare = F.regexp_replace(num, rf"(?i)^({LEVEL_WORDS})\s*", "")
    bare = F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9._-]+", "-"), "^-|-$", "")
    return F.concat(F.lower(level), F.lit("-"), F.coalesce(F.nullif(bare, F.lit("")), F.lit("untitled")))


def identifier(jurisdiction: Column, path: Column) -> Column:
    return F.concat(F.lit("/"), jurisdiction, F.lit("/"), path)


def temporal_id(section: Column) -> Column:
    return F.concat(F.lit("s"), F.replace(section, F.lit("."), F.lit("_")))


def slug_of_number(num: Column) -> Column:
    clean = F.trim(F.regexp_replace(num, r"\.$", ""))
    dashed = F.regexp_replace(F.lower(clean), r"\s+", "-")
    return F.when(F.lower(clean).rlike(r"^section\s"), dashed).otherwise(F.concat(F.lit("section-"), dashed))


def title_case(text: Column) -> Column:
    """Texts in capitals of more than three characters get a capital after every word boundary only."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    cased = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.right(r, F.length(r) - 1))), "")
    return F.when((text == F.upper(text)) & (F.length(text) > 3), cased).otherwise(text)


TITLE = r"^(.+?)\.?\s+[-–—]\s+(.+)$"


def title_parts(text: Column) -> tuple[Column, Column]:
    """Number and heading of a contents title: 'CHAPTER 5 - ANIMALS'; without a separator all of it is the number."""
    split = text.rlike(TITLE)
    heading = title_case(F.regexp_replace(F.trim(F.regexp_extract(text, TITLE, 2)), r"\.\s*$", ""))
    return F.when(split, F.trim(F.regexp_extract(text, TITLE, 1))).otherwise(F.trim(text)), F.when(split, heading).otherwise(F.lit(""))


def level_of(title: Column, depth: Column) -> Column:
    """Level that a heading's first word names, else one by its depth."""
    low = F.lower(title)
    out = F.when(F.startswith(low, F.lit("part ")), "part")
    for word in ("title", "article", "division", "chapter", "subchapter"):
        out = out.when(F.startswith(low, F.lit(f"{word} ")), word)
    out = out.when(F.startswith(low, F.lit("section ")) | low.rlike(r"^\d+[.-]"), "section")
    return out.when(depth <= 1, "part").when(depth == 2, "chapter").otherwise("section")


# How each publisher's headings begin, by level, in the order in which they are tried; the level of all others.
TITLE_LEVELS = {
    "amlegal": ((("title", "title "), ("chapter", "chapter ", "ch. "), ("article", "article ", "art. "), ("division", "division ", "div. "), ("part", "part "), ("section", "section ", "sec.", "§", "#")), "section"),
    "ecode360": ((("part", "part "), ("title", "title "), ("chapter", "chapter ", "ch ", "ch. "), ("article", "article ", "art. "), ("division", "division ", "div. "), ("section", "section ", "§", "#.")), "section"),
    "ca-leginfo": ((("title", "title "), ("division", "division ", "div. "), ("part", "part "), ("chapter", "chapter ", "ch. "), ("article", "article ", "art. "), ("section", "section ", "§", "#")), "title"),
    "usc": ((("subtitle", "subtitle"), ("chapter", "chapter"), ("subchapter", "subchapter"), ("part", "part"), ("subpart", "subpart"), ("division", "division"), ("article", "article")), "chapter"),
}
#: Levels of publishers' own type names.
TYPE_LEVELS = {
    "ecode360": {"code": "title", "division": "division", "chapter": "chapter", "article": "article", "section": "section", "part": "part", "subpart": "subpart", "appendix": "part"},
    "ecfr": {"title": "title", "subtitle": "subtitle", "chapter": "chapter", "subchapter": "subchapter", "part": "part", "subpart": "subpart", "subject_group": "division", "section": "section", "appendix": "part"},
}


def publisher_level(publisher: str, title: Column) -> Column:
    """Level of a heading as one publisher writes them: by its beginning ('#': a digit, '#.': a number and a mark), else its usual one."""
    rules, usual = TITLE_LEVELS[publisher]
    low = F.trim(F.lower(title)) if publisher == "ca-leginfo" else F.lower(title)
    begins = lambda form: low.rlike(r"^\d+[.-]") if form == "#." else low.rlike(r"^\d") if form == "#" else F.startswith(low, F.lit(form))
    out = F.when(F.lit(False), F.lit(""))
    for level, *forms in rules:
        out = out.when(reduce(Column.__or__, map(begins, forms)), level)
    return out.otherwise(usual)


def type_level(publisher: str, kind: Column) -> Column:
    """Level of a publisher's type name; of an unknown one by its beginning, or 'section'."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPE_LEVELS[publisher].items() for x in pair]), F.lower(kind) if publisher == "ecode360" else kind)
    return F.coalesce(known, publisher_level(publisher, kind) if publisher in TITLE_LEVELS else F.lit("section"))


def known_level(level: Column) -> Column:
    return F.when(F.lower(level).isin(*ENUMS["level"]), F.lower(level)).otherwise("section")


def strip_affixes(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, PREFIX, ""), STATE_SUFFIX, "")


def lookup_name(name: Column) -> Column:
    """Name as looked up: no 'City of', no state, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(strip_affixes(name)), r"\s+", " "))


def match_name(name: Column) -> Column:
    """Name as compared with gazetteer names: no display prefix or state, no punctuation."""
    bare = F.regexp_replace(name, STATE_SUFFIX, "")
    for prefix in DISPLAY_PREFIXES:
        bare = F.regexp_replace(bare, f"(?i)^{prefix}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(bare)), r"[^a-z0-9\s]", ""), r"\s+", " "))


def client_name(name: Column) -> Column:
    """Name as publishers list clients: no prefix, punctuation as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"^(city|town|village|county)\s+of\s+", ""), "[^a-z0-9]+", " "))


def clean_place(name: Column) -> Column:
    """Gazetteer name without its legal form; each form is cut once, in order."""
    return F.trim(reduce(lambda x, suffix: F.regexp_replace(x, f"(?i){suffix}$", ""), PLACE_SUFFIXES, name))


def kind_of(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("city and county")) | F.contains(low, F.lit("city & county")), "city").when(F.contains(low, F.lit("county")), "county").otherwise("city")


def norm(text: Column) -> Column:
    """Search tokens joined by single spaces: lower case, runs of letters and digits."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def fold(text: Column) -> Column:
    """Lower case without accents: marks are dropped, accented Latin letters become bare ones. ASCII texts skip that."""
    low = F.lower(text)
    return F.when(low.rlike("[^\\x00-\\x7f]"), F.regexp_replace(F.translate(low, *_folded()), r"\p{M}+", "")).otherwise(low)


def search_text(text: Column) -> Column:
    """Tokens as the search sees them, joined by single spaces: folded runs of letters and digits."""
    return norm(fold(text))


TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*[^\p{L}\p{N}]*"


def token_pieces(text: Column) -> Column:
    """The text itself in pieces, one for each token of search_text(): the token as written and what follows it."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token arrays' distinct tokens; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def strip_script_style(html: Column) -> Column:
    """Markup without script and style elements, data attributes and runs of blank lines."""
    for tag in ("style", "script"):
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return F.regexp_replace(F.regexp_replace(html, r'(?i)\s+data-[a-z-]+="[^"]*"', ""), r"\n\s*\n\s*\n", "\n\n")


def allow_tags(html: Column, tags: tuple[str, ...]) -> Column:
    """Markup in which only the given tags are left, without attributes."""
    parts = F.regexp_extract_all(html, F.lit("<[^>]*>|[^<]+"), F.lit(0))
    name = lambda p: F.lower(F.regexp_extract(p, "^<(/?[A-Za-z0-9]+)", 1))
    allowed = [*tags, *(f"/{t}" for t in tags)]
    keep = lambda p: F.when(~F.startswith(p, F.lit("<")), p).when(name(p).isin(*allowed), F.concat(F.lit("<"), name(p), F.lit(">"))).otherwise("")
    return F.array_join(F.transform(parts, keep), "")


def url_host(url: Column) -> Column:
    """Host of an http(s) URL in lower case, without www; null for other texts."""
    host = F.regexp_extract(url, "^https?://([^/:?#]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))


def truncate(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def compose_title(*parts: Column) -> Column:
    """Parts that aren't blank, joined by ' - '."""
    return F.concat_ws(" - ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, their lines joined by spaces."""
    blocks = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\s*\n")
    return F.filter(F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, r"\s+", " "))), lambda b: b != "")


def numbered_html(text: Column) -> Column:
    """Paragraph elements of plain text: a blank line ends one, a line that begins with a number and a full stop begins one."""
    apart = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?m)^[^\S\n]*(\d+\.[^\S\n]+\S)", "\n\n$1")
    return F.array_join(F.transform(paragraphs(apart), lambda p: F.concat(F.lit("<p>"), escape_xml(p), F.lit("</p>"))), "\n")


def node_id(level: Column, title: Column) -> Column:
    """level|slug of a contents title, at most 80 characters of slug."""
    return F.concat(level, F.lit("|"), F.left(slugify(title), F.lit(80)))


def chapter_of_link(href: Column) -> Column:
    """chapter|file of a statute link's URL parameter; null without one."""
    return F.concat(F.lit("chapter|"), F.nullif(F.regexp_extract(href, r"URL=([^&\s]+)", 1), F.lit("")))


def statute_link(base: str, section: Column) -> Column:
    """Public address by the section number in an id, else by its chapter file's number; null if it has neither."""
    number = F.nullif(F.regexp_extract(section, r"(\d+\.\d+)", 1), F.lit(""))
    chapter = F.nullif(F.regexp_extract(section, r"/(\d{4})/\d{4}\.html", 1), F.lit("")).cast("int").cast("string")
    return F.concat(F.lit(f"{base}/"), F.coalesce(number, chapter))


def paragraphs_of_html(html: Column) -> Column:
    """Texts of well-formed p elements, escaped for XML; the whole text where there is none."""
    inner = F.regexp_extract_all(html, F.lit("(?is)<p(?: [^>]*)?>(.*?)</p>"), F.lit(1))
    found = F.filter(F.transform(inner, lambda p: escape_xml(strip_html(p))), lambda p: p != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(escape_xml(strip_html(html))))
