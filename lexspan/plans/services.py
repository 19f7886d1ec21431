"""Inserts, migrations, listings, caches and the smaller steps of the services."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import caselaw, changes, logs, registry, resolve, tree
from .base import events, pick, pick_sql, query, table


@query("select s_suppkey id, 'resolved' status, null::varchar note from supplier union all select c_custkey + 1000000, coalesce(case when c_mktsegment = 'BUILDING' then 'triaged' end, 'pending'), c_name from customer")
def insert_feedback(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.lit("resolved").alias("status"), F.lit(None).cast("string").alias("note"))
    new = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000000).cast("long").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "triaged").alias("status"), F.col("c_name").alias("note"))
    return changes.insert_rows(old, new, status="pending")


@query("select c_name, c_nationkey, c_mktsegment from customer where not (c_nationkey = 3 and c_mktsegment = 'BUILDING') union all select s_name, s_nationkey, 'BUILDING' from supplier where s_nationkey = 3")
def replace_scope(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_name", "c_nationkey", "c_mktsegment")
    new = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    return changes.replace_scope(old, new, c_nationkey=3, c_mktsegment="BUILDING")


@query("select o_orderkey, o_custkey, '_default' code_id from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def migrate_column(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return changes.migrate(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "code_id", "_default", parents, ["o_custkey"])


@query("select o_orderkey from orders where o_orderstatus <> 'P' and (case when o_totalprice > 200000 then o_orderdate end) is null")
def current_versions(spark, sf_dir):
    ends = F.when(F.col("o_totalprice") > 200000, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") != "P") & ends.isNull()).select("o_orderkey")


def catalog(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.when(F.col("c_acctbal") < 0, "cached").otherwise("known").alias("status"))
    return rows, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))


LISTED = "select c_custkey id, c_name name, c_mktsegment as type, case when c_custkey in (select s_suppkey from supplier) then 'cached' when c_acctbal < 0 then 'available' else 'known' end status from customer"


@query(f"select * from ({LISTED}) where status = 'cached' and type = 'BUILDING'")
def listing_cached(spark, sf_dir):
    rows, cached = catalog(spark, sf_dir)
    return registry.listing(rows, cached, "id", only_cached=True, type="BUILDING").select("id", "name", "type", "status")


@query(f"select * from ({LISTED}) where contains(lower(name), 'r#00000001') order by id limit 1000 offset 5")
def listing_named(spark, sf_dir):
    rows, cached = catalog(spark, sf_dir)
    return registry.listing(rows, cached, "id", name="R#00000001", limit=5000, offset=5).select("id", "name", "type", "status")


@query(f"select * from ({LISTED}) where type = 'MACHINERY' order by id limit 100")
def listing_filtered(spark, sf_dir):
    rows, cached = catalog(spark, sf_dir)
    return registry.listing(rows, cached, "id", type="MACHINERY").select("id", "name", "type", "status")


@query("select event_id, c_name, c_mktsegment from events join customer on user_id = c_custkey where event_type = 'error'")
def feedback_summary(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id").join(items, "user_id").select("event_id", "c_name", "c_mktsegment")


@query("select c_custkey, n_name from customer join nation on n_nationkey = c_nationkey")
def code_ids(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return resolve.codes_known(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", names, "n_name").select("c_custkey", "n_name")


@query("select count(*) completed, count(*) filter (where event_type = 'error') errors, count(*) filter (where event_type is distinct from 'error') succeeded from events")
def run_outcome(spark, sf_dir):
    return changes.outcome(table(spark, sf_dir, "events"), F.col("event_type") == "error")


@query("select event_type, count(*) n from events group by event_type")
def log_histogram(spark, sf_dir):
    return logs.histogram(table(spark, sf_dir, "events"), "event_type")


@query("select c_custkey, to_json({'name': c_name, 'children': [{'slug': c_mktsegment}, {'slug': 'n-' || c_nationkey}]}) node from customer")
def strip_ids(spark, sf_dir):
    child = lambda slug: F.struct(F.lit(1).alias("sourceId"), slug.alias("slug"))
    node = F.struct(F.col("c_custkey").alias("sourceId"), F.col("c_name").alias("name"), F.array(child(F.col("c_mktsegment")), child(F.concat(F.lit("n-"), F.col("c_nationkey").cast("string")))).alias("children"))
    return changes.without_fields(table(spark, sf_dir, "customer").select("c_custkey", node.alias("node")), "sourceId").select("c_custkey", F.to_json("node").alias("node"))


@query("select 'region-' || r_regionkey id, null::varchar parent, r_name title from region union all select distinct 'nation-' || n_nationkey, 'region-' || n_regionkey, n_name from nation")
def browse_expand(spark, sf_dir):
    top = table(spark, sf_dir, "region").select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"), F.col("r_regionkey").cast("long").alias("ord"), F.lit(False).alias("has_content"))
    links = table(spark, sf_dir, "nation").select(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("long").alias("ord"))
    again = links.select("parent", F.col("parent").alias("id"), "title", "ord")  # links of a page to itself
    return tree.expand(top, links.unionByName(links).unionByName(again)).select("id", "parent", "title")


SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
HREFS = ["index.cfm?URL=0000-0099/00{}/00{}.html", "/Sections/{}.49.html", "plain-{}"]


@query(f"with h as (select p_partkey, p_type, p_name, replace({pick_sql(HREFS, 'p_partkey')}, '{{}}', (p_partkey % 90 + 10)::varchar) href from part), "
       "c as (select *, 'chapter|' || nullif(regexp_extract(href, 'URL=([^&\\s]+)', 1), '') chapter from h) "
       f"select p_partkey, lower(p_type) || '|' || left({SLUG.format('p_name')}, 80) node, chapter, 'https://x.test/' || coalesce(nullif(regexp_extract(href, '(\\d+\\.\\d+)', 1), ''), nullif(regexp_extract(href, '/(\\d{{4}})/\\d{{4}}\\.html', 1), '')::int::varchar) link from c")  # fmt: skip
def node_ids(spark, sf_dir):
    href = F.replace(pick(HREFS, F.col("p_partkey")), F.lit("{}"), (F.col("p_partkey") % 90 + 10).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", T.node_id(F.lower("p_type"), F.col("p_name")).alias("node"), T.chapter_of_link(href).alias("chapter"), T.statute_link("https://x.test", href).alias("link"))


HEADS = ["Title ", "Ch. ", "ARTICLE ", "Div. ", "Part ", "Sec.", "§ ", "Subchapter ", "Appendix ", "ch ", ""]
KINDS = ["Code", "subject_group", "chapter", "APPENDIX", "Sec 1", "subpart", "Part 9", "x"]


def levels_sql(publisher: str, title: str) -> str:
    rules, usual = T.TITLE_LEVELS[publisher]
    test = lambda f: f"regexp_matches({title}, '^\\d+[.-]')" if f == "#." else f"regexp_matches({title}, '^\\d')" if f == "#" else f"starts_with({title}, '{f}')"
    return "case " + " ".join("when " + " or ".join(map(test, forms)) + f" then '{level}'" for level, *forms in rules) + f" else '{usual}' end"


def types_sql(publisher: str, kind: str, other: str) -> str:
    return "case " + kind + " " + " ".join(f"when '{a}' then '{b}'" for a, b in T.TYPE_LEVELS[publisher].items()) + f" else {other} end"


@query(f"with h as (select p_partkey, lower({pick_sql(HEADS, 'p_partkey')} || p_size || '. ' || p_name) h, {pick_sql(KINDS, 'p_partkey')} k from part) select p_partkey, {levels_sql('amlegal', 'h')} amlegal, {levels_sql('ecode360', 'h')} ecode360, "
       f"{levels_sql('ca-leginfo', 'trim(h)')} california, {levels_sql('usc', 'h')} usc, {types_sql('ecode360', 'lower(k)', levels_sql('ecode360', 'lower(k)'))} kind360, {types_sql('ecfr', 'k', chr(39) + 'section' + chr(39))} kindcfr from h")  # fmt: skip
def level_variants(spark, sf_dir):
    head = F.concat(pick(HEADS, F.col("p_partkey")), F.col("p_size").cast("string"), F.lit(". "), F.col("p_name"))
    kind = pick(KINDS, F.col("p_partkey"))
    made = {"amlegal": T.publisher_level("amlegal", head), "ecode360": T.publisher_level("ecode360", head), "california": T.publisher_level("ca-leginfo", head), "usc": T.publisher_level("usc", head), "kind360": T.type_level("ecode360", kind), "kindcfr": T.type_level("ecfr", kind)}
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in made.items()])


ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
NUMBERED = "replace(replace(text, '. ', '.' || chr(10)), ', ', chr(10) || '12. ')"


@query(f"with n as (select doc_id, regexp_replace(regexp_replace({NUMBERED}, '\\r\\n?', chr(10), 'g'), '(?m)^[^\\S\\n]*(\\d+\\.[^\\S\\n]+\\S)', chr(10) || chr(10) || '\\1', 'g') t from documents) "
       f"select doc_id, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda b: trim(regexp_replace(b, '\\s+', ' ', 'g'))), lambda b: b <> ''), lambda b: '<p>' || {ESCAPED.format('b')} || '</p>'), chr(10)) html from n")  # fmt: skip
def numbered_paragraphs(spark, sf_dir):
    """Texts whose clauses are made numbered items, as paragraphs."""
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".\n")), F.lit(", "), F.lit("\n12. "))
    return table(spark, sf_dir, "documents").select("doc_id", T.numbered_html(text).alias("html"))


@query(f"select c_custkey, unnest(['municode', 'amlegal', 'amlegal']) publisher, unnest(['tx-' || {SLUG.format('c_name')}, replace({SLUG.format('c_name')}, '-', '_'), {SLUG.format('c_name')}]) id, unnest([0, 1, 2])::bigint as step from customer")
def probe_order(spark, sf_dir):
    found = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(resolve.probes(F.col("c_name"), F.lit("TX"))).alias("step", "p"))
    return found.select("c_custkey", "p.publisher", "p.id", F.col("step").cast("long").alias("step"))


@query("select o_orderkey, o_custkey || ' U.S.C. § ' || o_orderkey || ' OR ' || o_custkey || ' USC § ' || o_orderkey query, o_orderkey // 20 + 1 page from orders")
def opinion_query(spark, sf_dir):
    cite = lambda form: F.concat(F.col("o_custkey").cast("string"), F.lit(f" {form} § "), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", caselaw.query_text(F.array(cite("U.S.C."), cite("USC"))).alias("query"), caselaw.page_number(F.col("o_orderkey"), F.lit(20)).alias("page"))


@query("with a as (select c_custkey, case when c_custkey % 3 = 0 then 'BUILDING' else c_mktsegment end q from customer), l as (select o_custkey c_custkey, max(o_orderdate) checked_at from orders group by o_custkey), c as (select c_custkey, c_mktsegment logged from customer) "
       "select c_custkey, coalesce(checked_at > timestamp '1998-06-01' - interval 30 day and checked_at <= timestamp '1998-06-01' and q = logged, false) cached from a left join l using (c_custkey) left join c using (c_custkey)")  # fmt: skip
def citation_cache(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    asked = customers.select("c_custkey", F.array(F.when(F.col("c_custkey") % 3 == 0, "BUILDING").otherwise(F.col("c_mktsegment"))).alias("queries"))
    checked = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("checked_at"))
    log = customers.select("c_custkey", F.array("c_mktsegment").alias("queries")).join(checked, "c_custkey")
    return caselaw.from_cache(asked, log, F.lit("1998-06-01").cast("timestamp_ntz"), "c_custkey").select("c_custkey", "cached")


@query("select distinct p_partkey section, l_orderkey cluster_id from part join lineitem on l_partkey = p_partkey where p_size < 5 and l_quantity > 45")
def opinions_citing(spark, sf_dir):
    cite = lambda n: F.concat(F.col(n).cast("string"), F.lit(" USC"))
    sections = table(spark, sf_dir, "part").where("p_size < 5").select(F.col("p_partkey").alias("section"), F.array(cite("p_partkey"), F.concat(F.lit("x"), cite("p_partkey"))).alias("variants"))
    opinions = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("cluster_id"), F.array(cite("l_partkey"), F.lit("none")).alias("citations"))
    return caselaw.opinions_citing(sections, opinions)


@query("select kind, asked, least(greatest(coalesce(asked, given), 0), most) n from (values ('search', 20, 100), ('list', 100, 1000), ('feedback', 50, 200), ('annotations', 50, 200)) v(kind, given, most), (select distinct case when c_nationkey % 5 = 0 then null else (c_nationkey - 3) * 60 end::bigint asked from customer)")
def limit_clamps(spark, sf_dir):
    """What clamp() gives for every kind of list and each of the limits asked for in a table."""
    asked = table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") % 5 != 0, (F.col("c_nationkey") - 3) * 60).cast("long").alias("asked")).distinct()
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), changes.clamped(k, F.col("asked")).alias("n")) for k in changes.LIMITS])
    return asked.select("asked", F.explode(kinds).alias("x")).select("x.kind", "asked", F.col("x.n").cast("int").alias("n"))


@query("select c_custkey id, lower(c_mktsegment) parent, c_name name, null::timestamp last_crawled from customer")
def entry_projection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("parent"), F.col("c_name").alias("name"), F.lit(None).cast("timestamp_ntz").alias("last_crawled"))


@query("with r as (select s_suppkey fips, s_name name, s_acctbal pop from supplier where contains(lower(s_name), '0000001')) select fips, name, 1 origin from r union all "
       "select c_custkey, c_name, 2 from customer where contains(lower(c_name), '0000001') and c_mktsegment <> 'BUILDING' and c_custkey not in (select s_suppkey from supplier)")  # fmt: skip
def name_search_union(spark, sf_dir):
    """Catalog hits, then gazetteer hits of places that the catalog lacks; whole states (here: one segment) are no hits."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fips"), F.col("s_name").alias("name"))
    places = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("fips"), F.col("c_name").alias("name")).join(known.select("fips"), "fips", "left_anti")
    hit = F.contains(F.lower("name"), F.lit("0000001"))
    return known.where(hit).withColumn("origin", F.lit(1)).unionByName(places.where(hit).withColumn("origin", F.lit(2)))


@query("select c_custkey, lat from customer left join (select n_nationkey, n_regionkey, n_nationkey * 1.5 lat, 'BUILDING' kind from nation) on n_nationkey = c_nationkey and kind = c_mktsegment")
def state_centroid(spark, sf_dir):
    """A state's row takes the centroid under (type, state); rows of other types take none."""
    centres = table(spark, sf_dir, "nation").select(F.lit("BUILDING").alias("c_mktsegment"), F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") * 1.5).alias("lat"))
    return registry.match_exact(table(spark, sf_dir, "customer"), centres, ["c_mktsegment", "c_nationkey"], F.col("lat"), how="left").select("c_custkey", "lat")


@query("select event_id, status from (select event_id, case when event_type = 'error' then 'error' else 'ok' end status from events) where (select count(*) filter (where event_type = 'error') <= 0.5 * count(*) from events)")
def quality_gate(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))
    return changes.require_resolved(rows, F.col("status") == "error", 0.5)
