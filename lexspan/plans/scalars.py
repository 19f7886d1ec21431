"""Scalar functions on table columns and on literal relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T
from ..sources.files import STATE_OF_FIPS
from .base import pick, pick_sql, query, table

WS = "'\\s+', ' ', 'g'"
STRIP = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), chr(160), ' '), " + WS + "))"
SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"select page_id, {STRIP.format('html')} body from pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("body"))


@query(f"select item_id, {SLUG.format('text')} slug from benchmark")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.slugify(F.col("text")).alias("slug"))


LEVEL_WORDS = "title|subtitle|chapter|subchapter|article|subarticle|division|subdivision|part|subpart|section"
LEVELS, NUMS = ["chapter", "part", "section", "Title", "article"], ["Chapter ", "PART ", "Section ", "Sec. ", "title ", "Art_I & ", ""]
ENDS = ["", ".1", " ", "*"]


@query(f"with n as (select p_partkey, {pick_sql(LEVELS, 'p_partkey')} lev, {pick_sql(NUMS, 'p_partkey')} || case when p_size % 5 = 0 then '' else p_size::varchar end || {pick_sql(ENDS, 'p_size')} num from part) "
       f"select p_partkey, lower(lev) || '-' || coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(num, '(?i)^({LEVEL_WORDS})\\s*', '')), '[^a-z0-9._-]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'untitled') slug from n")  # fmt: skip
def make_slug(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    num = F.concat(pick(NUMS, key), F.when(size % 5 == 0, "").otherwise(size.cast("string")), pick(ENDS, size))
    return table(spark, sf_dir, "part").select("p_partkey", T.make_slug(pick(LEVELS, key), num).alias("slug"))


MARKS, STOPS = ["", "Section ", "SECTION  ", "12 "], ["", ".", " A."]


@query(f"with i as (select o_orderkey, 'ca-' || o_custkey jur, 'title-' || o_custkey % 9 || '/section-' || o_orderkey as path, {pick_sql(MARKS, 'o_orderkey')} || o_orderkey || '.' || o_custkey || {pick_sql(STOPS, 'o_custkey')} num from orders) "
       "select o_orderkey, '/' || jur || '/' || path ident, 's' || replace(num, '.', '_') temporal, case when regexp_matches(lower(trim(regexp_replace(num, '\\.$', ''))), '^section\\s') then '' else 'section-' end || regexp_replace(lower(trim(regexp_replace(num, '\\.$', ''))), '\\s+', '-', 'g') slug from i")  # fmt: skip
def identifiers(spark, sf_dir):
    order, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    num = F.concat(pick(MARKS, F.col("o_orderkey")), order, F.lit("."), customer, pick(STOPS, F.col("o_custkey")))
    path = F.concat(F.lit("title-"), (F.col("o_custkey") % 9).cast("string"), F.lit("/section-"), order)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.identifier(F.concat(F.lit("ca-"), customer), path).alias("ident"), T.temporal_id(num).alias("temporal"), T.slug_of_number(num).alias("slug"))


HEADINGS, DASHES, FULL = ["CHAPTER ", "Section ", "ARTICLE I", "  ", ""], [" - ", ". - ", " \u2013 ", "  \u2014 ", " "], ["", ".", ". "]
CASED = "case when {0} = upper({0}) and length({0}) > 3 then array_to_string(list_transform(regexp_extract_all(lower({0}), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda r: upper(left(r, 1)) || substr(r, 2)), '') else {0} end"
PARTED = "'^(.+?)\\.?\\s+[-\u2013\u2014]\\s+(.+)$'"


@query(f"with t as (select p_partkey, {pick_sql(HEADINGS, 'p_partkey')} || p_size || {pick_sql(DASHES, 'p_size')} || case when p_partkey % 2 = 0 then upper(p_name) else p_name end || {pick_sql(FULL, 'p_partkey')} title from part), "
       f"s as (select p_partkey, title, regexp_matches(title, {PARTED}) cut, regexp_replace(trim(regexp_extract(title, {PARTED}, 2)), '\\.\\s*$', '') h from t) "
       f"select p_partkey, case when cut then trim(regexp_extract(title, {PARTED}, 1)) else trim(title) end num, case when cut then {CASED.format('h')} else '' end heading from s")  # fmt: skip
def parse_title(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    title = F.concat(pick(HEADINGS, key), size.cast("string"), pick(DASHES, size), F.when(key % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), pick(FULL, key))
    num, heading = T.title_parts(title)
    return table(spark, sf_dir, "part").select("p_partkey", num.alias("num"), heading.alias("heading"))


SHAPES = ["{} {}", "{}-{}", "{}'S {}", "1ST {}_{}"]


@query(f"with t as (select p_partkey, replace({pick_sql(SHAPES, 'p_partkey')}, '{{}}', case when p_size % 3 = 0 then p_name when p_size % 3 = 1 then upper(p_name) else upper(left(p_type, 1)) end) s from part) select p_partkey, s, {CASED.format('s')} cased from t")
def title_case(spark, sf_dir):
    size, name = F.col("p_size"), F.col("p_name")
    text = F.replace(pick(SHAPES, F.col("p_partkey")), F.lit("{}"), F.when(size % 3 == 0, name).when(size % 3 == 1, F.upper(name)).otherwise(F.upper(F.left("p_type", F.lit(1)))))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("s"), T.title_case(text).alias("cased"))


HEADS = ["Part I", "TITLE ", "Article ", "Division ", "Chapter ", "Subchapter A", "Section ", "12.", "7-", "Preamble", "Notes "]


@query(f"with t as (select p_partkey, {pick_sql(HEADS, 'p_partkey')} || p_size h, p_size % 5 d from part) select p_partkey, h, case when lower(h) like 'part %' then 'part' when lower(h) like 'title %' then 'title' when lower(h) like 'article %' then 'article' when lower(h) like 'division %' then 'division' when lower(h) like 'chapter %' then 'chapter' "
       "when lower(h) like 'subchapter %' then 'subchapter' when lower(h) like 'section %' or regexp_matches(h, '^\\d+[.-]') then 'section' when d <= 1 then 'part' when d = 2 then 'chapter' else 'section' end as level from t")  # fmt: skip
def level_case(spark, sf_dir):
    head = F.concat(pick(HEADS, F.col("p_partkey")), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", head.alias("h"), T.known_level(T.level_of(head, F.col("p_size") % 5)).alias("level"))


BEFORE = ["City of ", "Town of ", "", "County of  ", "Village of ", "township of ", "City and County of ", "BOROUGH OF "]
AFTER = ["", ", CA", ", ca", " city", " CDP", " County", " village town", "  x", " Municipality", ", NJ "]
NAMED = f"(select c_custkey, {pick_sql(BEFORE, 'c_custkey')} || c_name || {pick_sql(AFTER, 'c_custkey // 8')} as name from customer)"


def places(spark, sf_dir):
    """Customers' names in the forms in which places are named."""
    name = F.concat(pick(BEFORE, F.col("c_custkey")), F.col("c_name"), pick(AFTER, F.floor(F.col("c_custkey") / 8)))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))


AFFIX = "regexp_replace(regexp_replace({}, '(?i)^(City of|Town of|Village of|County of|Borough of)\\s+', ''), ',\\s*[A-Z]{{2}}$', '')"
@query(f"select c_custkey, {AFFIX.format('name')} bare from {NAMED}")
def strip_affixes(spark, sf_dir):
    return places(spark, sf_dir).select("c_custkey", T.strip_affixes(F.col("name")).alias("bare"))


DISPLAY = "regexp_replace(name, ',\\s*[A-Z]{2}$', '')"
for _p in T.DISPLAY_PREFIXES:
    DISPLAY = f"regexp_replace({DISPLAY}, '(?i)^{_p}', '')"


@query(f"select c_custkey, trim(regexp_replace(lower({AFFIX.format('name')}), {WS})) lookup, trim(regexp_replace(regexp_replace(lower(trim({DISPLAY})), '[^a-z0-9\\s]', '', 'g'), {WS})) matched, "
       f"trim(regexp_replace(regexp_replace(lower(name), '^(city|town|village|county)\\s+of\\s+', ''), '[^a-z0-9]+', ' ', 'g')) client from {NAMED}")  # fmt: skip
def normalize_name(spark, sf_dir):
    n = F.col("name")
    return places(spark, sf_dir).select("c_custkey", T.lookup_name(n).alias("lookup"), T.match_name(n).alias("matched"), T.client_name(n).alias("client"))


CLEAN = "name"
for _s in T.PLACE_SUFFIXES:
    CLEAN = f"regexp_replace({CLEAN}, '(?i){_s}$', '')"


@query(f"select c_custkey, trim({CLEAN}) clean from {NAMED}")
def clean_suffixes(spark, sf_dir):
    return places(spark, sf_dir).select("c_custkey", T.clean_place(F.col("name")).alias("clean"))


@query(f"select c_custkey, case when contains(lower(name), 'city and county') or contains(lower(name), 'city & county') then 'city' when contains(lower(name), 'county') then 'county' else 'city' end kind from {NAMED}")
def infer_type(spark, sf_dir):
    return places(spark, sf_dir).select("c_custkey", T.kind_of(F.col("name")).alias("kind"))


@query("select a.item_id, round(coalesce(len(list_intersect(a.s, b.s))::double / nullif(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)), 0), 0), 6) similarity from "
       "(select item_id, list_distinct(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) s from benchmark) a join (select item_id - 1 item_id, list_distinct(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) s from benchmark) b using (item_id)")  # fmt: skip
def jaccard(spark, sf_dir):
    words = F.split(T.norm(F.col("text")), " ")
    a = table(spark, sf_dir, "benchmark").select("item_id", words.alias("a"))
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") - 1).alias("item_id"), words.alias("b"))
    return a.join(b, "item_id").select("item_id", F.round(T.jaccard(F.col("a"), F.col("b")).cast("double"), 6).alias("similarity"))


CODED = "lpad((c_custkey % 100)::varchar, 2, '0') || case when c_custkey % 7 = 0 then '' else lpad(c_custkey::varchar, 5, '0') end"


@query(f"with f as (select c_custkey, {CODED} fips from customer) select c_custkey, fips, case left(fips, 2) " + " ".join(f"when '{k}' then '{v}'" for k, v in STATE_OF_FIPS.items()) + " end state from f")
def map_lookup(spark, sf_dir):
    states = F.create_map(*[F.lit(x) for kv in STATE_OF_FIPS.items() for x in kv])
    key = F.col("c_custkey")
    fips = F.concat(F.lpad((key % 100).cast("string"), 2, "0"), F.when(key % 7 == 0, "").otherwise(F.lpad(key.cast("string"), 5, "0")))
    return table(spark, sf_dir, "customer").select("c_custkey", fips.alias("fips"), F.try_element_at(states, F.left(fips, F.lit(2))).alias("state"))


ESCAPE = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"select page_id, {ESCAPE.format('html')} escaped from pages")
def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escape_xml(F.col("html")).alias("escaped"))


@query("with p as (select page_id, html, list_filter(list_transform(regexp_extract_all(html, '(?is)<p(?: [^>]*)?>(.*?)</p>', 1), lambda x: " + ESCAPE.format(STRIP.format("x")) + "), lambda x: x <> '') l from pages) "
       "select page_id, array_to_string(case when len(l) > 0 then l else [" + ESCAPE.format(STRIP.format("html")) + "] end, chr(10)) body from p")  # fmt: skip
def html_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.paragraphs_of_html(F.col("html")), "\n").alias("body"))


LINK = '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'


@query(f"with l as (select page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) href, unnest(regexp_extract_all(html, '{LINK}', 2)) label, generate_subscripts(regexp_extract_all(html, '{LINK}', 1), 1) n from pages) "
       "select page_id, href, label from (select *, row_number() over (partition by page_id, href order by n) k from l where length(label) >= 3) where k = 1")  # fmt: skip
def link_harvest(spark, sf_dir):
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("label"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(both).alias("n", "l")).select("page_id", "n", F.col("l.href").alias("href"), F.col("l.label").alias("label"))
    return rows.where(F.length("label") >= 3).groupBy("page_id", "href").agg(F.min_by("label", "n").alias("label"))


@query("select p_partkey, concat_ws(' - ', nullif(trim(p_name), ''), nullif(trim(case when p_size < 20 then '  ' else p_brand end), ''), nullif(trim(p_type), '')) title from part")
def compose_title(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.compose_title(F.col("p_name"), F.when(F.col("p_size") < 20, "  ").otherwise(F.col("p_brand")), F.col("p_type")).alias("title"))


COMPOSITE = ["doc{}:s-{}", "{}:b:{}", "no{}"]


@query(f"with c as (select o_orderkey, o_orderstatus || '|' || case when o_orderkey % 3 = 0 then '' else 'division=' || o_custkey || '.' end a, replace({pick_sql(COMPOSITE, 'o_orderkey')}, '{{}}', o_custkey::varchar) b from orders) "
       "select o_orderkey, split_part(a, '|', 1) code, split_part(a, '|', 2) q, split_part(b, ':', 1) doc, split_part(b, ':', 2) section from c")  # fmt: skip
def split_ids(spark, sf_dir):
    customer = F.col("o_custkey").cast("string")
    a = F.concat("o_orderstatus", F.lit("|"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("division="), customer, F.lit("."))))
    b = F.replace(pick(COMPOSITE, F.col("o_orderkey")), F.lit("{}"), customer)
    part = lambda c, sep, n: F.split_part(c, F.lit(sep), F.lit(n))
    return table(spark, sf_dir, "orders").select("o_orderkey", part(a, "|", 1).alias("code"), part(a, "|", 2).alias("q"), part(b, ":", 1).alias("doc"), part(b, ":", 2).alias("section"))


@query("select doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n\\s*\\n'), lambda b: trim(regexp_replace(b, '\\s+', ' ', 'g'))), lambda b: b <> ''), '|') blocks from documents")
def paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.paragraphs(F.col("text")), "|").alias("blocks"))


@query("select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?i)\\s+data-[a-z-]+=\"[^\"]*\"', '', 'g'), '\\n\\s*\\n\\s*\\n', chr(10) || chr(10), 'g') clean from pages")
def strip_script_style(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_script_style(F.col("html")).alias("clean"))


SCRIPTS = ['<script>window._redux_state = {"a": {"b": #}}; </script>', '<script>window.__PRELOADED_STATE__ = {"a": {"b": #}, "c": "};"};</script><script>x</script>', "<p>none #</p>", '<script>window._redux_state = {"a": #};</script>']
STATE = "(?s)window\\.(?:_redux_state|__PRELOADED_STATE__)\\s*=\\s*(\\{.*?\\});\\s*</script>"


@query(f"select p_partkey, json_extract_string(case when js <> '' then js end, '$.a.b')::bigint b from (select p_partkey, regexp_extract(replace({pick_sql(SCRIPTS, 'p_partkey')}, '#', p_size::varchar), '{STATE}', 1) js from part)")
def json_extract(spark, sf_dir):
    page = F.replace(pick(SCRIPTS, F.col("p_partkey")), F.lit("#"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.get_json_object(F.regexp_extract(page, STATE, 1), "$.a.b").cast("long").alias("b"))


@query("select page_id, array_to_string(list_transform(regexp_extract_all(html, '<[^>]*>|[^<]+'), lambda p: case when not starts_with(p, '<') then p when lower(regexp_extract(p, '^<(/?[A-Za-z0-9]+)', 1)) in ('p', 'b', '/p', '/b') then '<' || lower(regexp_extract(p, '^<(/?[A-Za-z0-9]+)', 1)) || '>' else '' end), '') clean from pages")
def sanitize_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.allow_tags(F.col("html"), ("p", "b")).alias("clean"))


@query("select page_id, nullif(regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', ''), '') host from pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))


@query("select page_id, nullif(regexp_extract(url, '[?&]page=([^&]*)', 1), '') page, nullif(regexp_extract(url, '[?&]ref=([^&]*)', 1), '') ref from pages where contains(url, '?')")
def query_map(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").where(F.contains("url", F.lit("?"))).select("page_id", F.str_to_map(F.split_part("url", F.lit("?"), F.lit(2)), F.lit("&"), F.lit("=")).alias("m"))
    return rows.select("page_id", F.nullif(F.try_element_at("m", F.lit("page")), F.lit("")).alias("page"), F.nullif(F.try_element_at("m", F.lit("ref")), F.lit("")).alias("ref"))


IPS = ["10.0.0.#, 10.0.0.2", " 10.0.1.# ", "", "#,,x"]


@query(f"with i as (select event_id, replace({pick_sql(IPS, 'event_id')}, '#', user_id::varchar) ips from events) select event_id, trim(split_part(ips, ',', 1)) ip from i")
def first_csv(spark, sf_dir):
    ips = F.replace(pick(IPS, F.col("event_id")), F.lit("#"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.trim(F.element_at(F.split(ips, ","), 1)).alias("ip"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') iso from orders")
def date_fmt(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("select c_custkey, case when c_acctbal > 7500 then 8 when c_acctbal > 5000 then 6 when c_acctbal > 1000 then 4 else 3 end radius from customer")
def bucketize(spark, sf_dir):
    bal = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(bal > 7500, 8).when(bal > 5000, 6).when(bal > 1000, 4).otherwise(3).alias("radius"))


SEGMENTS, SIGNS = ["title-42/section-", "part-1/x-", "part-", "section-1/part-"], ["Section ", "\u00a7 ", "Sec. ", " ", "Notes ", "sec", ""]


@query(f"with s as (select o_orderkey, {pick_sql(SEGMENTS, 'o_orderkey')} || o_orderkey || '.' || o_custkey as path, case when o_custkey % 11 <> 0 then {pick_sql(SIGNS, 'o_custkey')} || o_orderkey || '.' || o_custkey || ' ' end num from orders) "
       "select o_orderkey, path, num, coalesce(nullif(regexp_extract(split_part(path, '/', -1), '^section-(.+)$', 1), ''), nullif(trim(regexp_extract(num, '(?i)(?:Section|\u00a7|Sec\\.?)\\s*(.+)', 1)), ''), case when regexp_matches(trim(num), '^[\\d.]+$') then trim(num) end) section from s")  # fmt: skip
def section_number(spark, sf_dir):
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    number = F.concat(order.cast("string"), F.lit("."), customer.cast("string"))
    path, num = F.concat(pick(SEGMENTS, order), number), F.when(customer % 11 != 0, F.concat(pick(SIGNS, customer), number, F.lit(" ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"), num.alias("num"), C.section_number(path, num).alias("section"))


CITING = ["usc", "ecfr", "ca-leginfo", "ny-openleg", "tx-statutes", "fl-statutes", "municode", "oh-statutes"]
CODES, LAWS, TEXAN = [*C.CALIFORNIA, "XYZ"], [*C.NEW_YORK, "ny-none"], [*C.TEXAS, "none"]


def case(table: dict[str, str], key: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '" + v.replace("'", "''") + "'" for k, v in table.items()) + " end"


JURISDICTION = f"case publisher when 'ny-openleg' then {pick_sql(LAWS, 'k // 8')} when 'tx-statutes' then 'tx-' || {pick_sql(TEXAN, 'k // 8')} || '-code' when 'municode' then 'ca-x' else 'us-x-title-' || k % 54 end"
FORMS = " ".join([
    "when section is null then []", "when publisher = 'usc' then [t || ' U.S.C. \u00a7 ' || section, t || ' USC \u00a7 ' || section, t || ' U.S.C. ' || section]", "when publisher = 'ecfr' then [t || ' C.F.R. \u00a7 ' || section, t || ' CFR \u00a7 ' || section]",
    f"when publisher = 'ca-leginfo' then ['Cal. ' || {case(C.CALIFORNIA, 'code')} || ' Code \u00a7 ' || section, 'California ' || {case(C.CALIFORNIA, 'code')} || ' Code \u00a7 ' || section, {case(C.CALIFORNIA_LONG, 'code')} || ' Code section ' || section]",
    f"when publisher = 'ny-openleg' then ['N.Y. ' || {case(C.NEW_YORK, 'jur')} || ' Law \u00a7 ' || section]", f"when publisher = 'tx-statutes' then ['Tex. ' || coalesce({case(C.TEXAS, 'law')} || ' Code \u00a7 ', '\u00a7 ') || section]",
    f"else [{case(C.STATES, 'publisher')} || ' \u00a7 ' || section]",
])


@query(f"with p as (select o_orderkey, o_custkey k, {pick_sql(CITING, 'o_custkey')} publisher, {pick_sql(CODES, 'o_custkey // 8')} code, case when o_custkey % 13 <> 0 then o_orderkey || '.5' end section from orders), "
       f"j as (select *, {JURISDICTION} jur from p), t as (select *, nullif(regexp_extract(jur, 'title-(\\d+)', 1), '') t, regexp_extract(jur, '^[a-z]{{2}}-(.+)-code$', 1) law from j) "
       f"select o_orderkey, publisher, jur, array_to_string(list_filter(case {FORMS} end, lambda x: x is not null), '|') variants from t")  # fmt: skip
def citation_variants(spark, sf_dir):
    k = F.col("o_custkey")
    publisher, eighth = pick(CITING, k), F.floor(k / 8)
    jur = F.when(publisher == "ny-openleg", pick(LAWS, eighth)).when(publisher == "tx-statutes", F.concat(F.lit("tx-"), pick(TEXAN, eighth), F.lit("-code"))).when(publisher == "municode", "ca-x").otherwise(F.concat(F.lit("us-x-title-"), (k % 54).cast("string")))
    section = F.when(k % 13 != 0, F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", publisher.alias("publisher"), jur.alias("jur"), F.lower(pick(CODES, eighth)).alias("code"), section.alias("section"))
    made = C.citation_variants(F.col("publisher"), F.col("jur"), F.col("code"), F.col("section"))
    return rows.select("o_orderkey", "publisher", "jur", F.array_join(made, "|").alias("variants"))


KINDS, CODE_IDS = ["federal", "city", "hoa", "county"], ["_default", "zoning", "gov"]
BARE = "regexp_replace(regexp_replace(name, '(?i)^(City of|Town of|Village of|County of|Borough of)\\s+', ''), ',\\s*[A-Z]{2}$', '')"


@query(f"with n as (select c_custkey, name, {pick_sql(KINDS, 'c_custkey')} kind, case when c_custkey % 3 <> 0 then 'CA' end state, {pick_sql(CODE_IDS, 'c_custkey')} code, case when c_custkey % 5 <> 0 then 'a/b-' || c_custkey else '' end as path from {NAMED}) "
       f"select c_custkey, concat_ws('/', 'https://x.test', case when kind = 'federal' then 'federal/' || 'usc-' || c_custkey when state is not null then lower(state) || '/' || {SLUG.format(BARE)} else 'us-usc-' || c_custkey end, case when code <> '_default' then code end, nullif(path, '')) url from n")  # fmt: skip
def permalink(spark, sf_dir):
    key = F.col("c_custkey")
    path = F.when(key % 5 != 0, F.concat(F.lit("a/b-"), key.cast("string"))).otherwise("")
    made = C.permalink("https://x.test", pick(KINDS, key), F.concat(F.lit("us-usc-"), key.cast("string")), F.col("name"), F.when(key % 3 != 0, "CA"), pick(CODE_IDS, key), path)
    return places(spark, sf_dir).select("c_custkey", made.alias("url"))


@query("select o_orderkey, coalesce(nullif(case when o_totalprice < 50000 then '' else o_orderpriority end, ''), 'Unknown Case') case_name, case when o_orderstatus <> 'P' then o_orderstatus end citation from orders")
def coalesce_defaults(spark, sf_dir):
    name = F.when(F.col("o_totalprice") < 50000, "").otherwise(F.col("o_orderpriority"))
    cites = F.when(F.col("o_orderstatus") != "P", F.array("o_orderstatus")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown Case")).alias("case_name"), F.try_element_at(cites, F.lit(1)).alias("citation"))
